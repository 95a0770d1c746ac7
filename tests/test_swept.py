import dataclasses
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.challenge import TESTS
from tidemark.operators.evidence import EvidenceError
from tidemark.operators.intervals import overlapping, spike_counts, within
from tidemark.operators.investigate import run_case
from tidemark.operators.swept import investigated
from tidemark.plans.contract import Driver, contract_of
from tidemark.plans.panel import Fact, Model

DRIVERS = [
    {"id": "integration", "probe": "ticket_spike", "max_lag_days": 45},
    {"id": "pricing", "probe": "price_delta", "max_lag_days": 60},
    {"id": "offer", "probe": "lost_reason_scan", "max_lag_days": 90},
    {"id": "supply", "probe": "incident_scan", "max_lag_days": 30},
    {"id": "season"},
]


def _contract(name, formula, **more):
    return contract_of({"id": name, "formula": formula, "materiality": {"relative": 0.03, "absolute": 100.0, "min_persistence": 1}, "history_start": "2022-01-01", "drivers": DRIVERS} | more)


@pytest.fixture(scope="module")
def world(spark):
    """Two regions of ten accounts, each with a loss of its own in another month, after tickets, prices, news and incidents of all kinds."""
    accounts = spark.createDataFrame([(f"{r[0]}{i:02d}", r, "smb" if i < 7 else "large") for r in ("East", "West") for i in range(10)], "account_id string, region string, segment string")
    lost = {("E00", "2024-03"): 900.0, ("E01", "2024-03"): 800.0, ("W02", "2024-02"): 700.0, ("W07", "2024-03"): -950.0}
    bills, ticket = [], []
    for r in "EW":
        for i in range(10):
            for m in range(1, 4):
                a, month = f"{r}{i:02d}", f"2024-{m:02d}"
                bills.append((a, f"P{i % 3}", date(2024, m, 5), 10.0 + (m == 3) * (i % 4), 1000.0 + 7 * i * m % 11 - lost.get((a, month), 0.0), datetime(2024, m, 6)))
                for day in range(1, 29):
                    ticket += [(a, datetime(2024, m, day, 10))] * (6 if (a in ("E00", "E01", "W05") and m == 3 and day >= 10) else 1 + (i * day % 5 == 0))
    days = "account_id string, product_id string, invoice_date date, qty double, amount_net double, _ingested_at timestamp_ntz"
    invoice = spark.createDataFrame(bills, days)
    tables = {
        "account": accounts,
        "ticket": spark.createDataFrame(ticket, "account_id string, created_at timestamp_ntz"),
        "renewal": spark.createDataFrame([("E00", date(2024, 3, 20)), ("E01", date(2024, 3, 25)), ("W02", date(2024, 2, 9)), ("W07", date(2024, 3, 2)), ("W07", date(2024, 3, 3))], "account_id string, closed_date date"),
        "price_book": spark.createDataFrame([("smb", date(2024, 2, 1)), ("smb", date(2023, 12, 20)), ("large", date(2024, 3, 31))], "segment string, effective_from date"),
        "news_item": spark.createDataFrame([(datetime(2024, 2, 1), "Rival", "West"), (datetime(2023, 12, 30), None, "East"), (datetime(2024, 1, 5), "Other", None)], "published_at timestamp_ntz, competitor string, region string"),
        "opportunity": spark.createDataFrame([("E00", 0, date(2024, 3, 5), "competitor_price"), ("W02", 0, date(2024, 2, 6), "budget"), ("W02", 1, date(2024, 2, 6), None)], "account_id string, closed_won int, close_date date, lost_reason_code string"),
        "incident": spark.createDataFrame([("I1", "api", datetime(2024, 2, 27), datetime(2024, 3, 2), "high", "E01|W09"), ("I2", "api", datetime(2024, 1, 1), None, "high", "W02")], "incident_id string, service string, started_at timestamp_ntz, resolved_at timestamp_ntz, severity string, affected_accounts string"),
    }
    contracts = [_contract("revenue", "SUM(invoice.amount_net)"), _contract("price", "SUM(invoice.amount_net) / SUM(invoice.qty)"), _contract("bills", "COUNT(invoice.qty) / 2.0"), _contract("mean", "AVG(invoice.amount_net)")]
    return Model({"invoice": Fact(invoice, "invoice_date", "_ingested_at")}, accounts), contracts, tables


def _openings(spark, slices):
    return spark.createDataFrame([("-".join(s), *s, None) for s in slices], "case_id string, kpi string, period string, region string, ceiling string")


SLICES = [(k, p, r) for k, p in (("revenue", "2024-03"), ("revenue", "2024-02"), ("price", "2024-03"), ("mean", "2024-03"), ("bills", "2024-03")) for r in ("East", "West")]
#: These are investigated alone, too.
ALONE = [("revenue", "2024-03", "East"), ("revenue", "2024-02", "West"), ("price", "2024-03", "West"), ("bills", "2024-03", "East")]
COLUMNS = ["driver", *TESTS, "tier", "status", "confidence", "rank"]


def test_all_cases_at_once_are_as_each_alone(spark, world):
    m, contracts, tables = world
    got = investigated(m, contracts, _openings(spark, SLICES), tables).collect()
    assert len(got) == 4 * len(SLICES)
    outcomes = set()
    for k, p, r in ALONE:
        alone = run_case(m, next(c for c in contracts if c.id == k), p, {"region": r}, "2024-01", tables, force=True)
        want = {x.driver: x for x in alone.verdict.collect()}
        mine = {x.driver: x for x in got if x.case_id == f"{k}-{p}-{r}"}
        assert mine.keys() == want.keys()
        for d, x in mine.items():
            assert [x[c] for c in COLUMNS] == [want[d][c] for c in COLUMNS], (k, p, r, d)
            for c in ("share", "priority", "total_delta", "footprint_delta"):
                assert x[c] == pytest.approx(want[d][c]) if x[c] is not None else want[d][c] is None, (k, p, r, d, c)
            outcomes |= {(t, x[t]) for t in TESTS}
    assert {("timing", "pass"), ("timing", "refute"), ("locality", "pass"), ("locality", "refute"), ("control", "pass")} <= outcomes


def _jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"counted-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_the_number_of_jobs_does_not_depend_on_the_cases(spark, world):
    m, contracts, tables = world
    n = [_jobs(spark, lambda k=k: investigated(m, contracts, _openings(spark, SLICES[::k]), tables).write.format("noop").mode("overwrite").save()) for k in (2, 1)]
    assert n[1] < 1.1 * n[0], n  # Spark leaves out a job where a side is empty


def test_missing_tables_leave_drivers_undecided(spark, world):
    m, contracts, tables = world
    got = investigated(m, contracts[:1], _openings(spark, SLICES[:1]), {"account": tables["account"]}).collect()
    assert {(x.driver, x.timing, x.locality, x.dose) for x in got} == {(d, "inconclusive", "inconclusive", "inconclusive") for d in ("integration", "pricing", "offer", "supply")}
    assert investigated(m, contracts, _openings(spark, []), tables).count() == 0
    with pytest.raises(ValueError, match="no contract"):
        investigated(m, [dataclasses.replace(contracts[0], drivers=())], _openings(spark, []), tables)


def test_a_probe_of_sql_runs_over_all_cases(spark, world, tmp_path):
    """A contract's own probe finds in each of many cases what it finds in that case alone."""
    m, contracts, tables = world
    path = tmp_path / "busy.sql"
    path.write_text(
        "SELECT case_id, account_id AS about, 'found' AS outcome, count(*) > 100 AS supported, 0.7 AS strength, NULL AS denominator, concat(account_id, ': ', count(*)) AS claim"
        " FROM {ticket} JOIN {footprints} USING (account_id) WHERE created_at >= start AND created_at < end GROUP BY case_id, account_id"
    )
    own = dataclasses.replace(contracts[0], drivers=(*contracts[0].drivers, Driver("busy", probe=str(path), max_lag_days=10)))
    mine = [x for x in SLICES if x[0] == "revenue"]
    got = {(x.case_id, x.driver): x for x in investigated(m, [own], _openings(spark, mine), tables).collect()}
    assert len(got) == 5 * len(mine) and len({got["-".join(s), "busy"].found_support for s in mine}) == 2
    for k, p, r in [("revenue", "2024-03", "East"), ("revenue", "2024-02", "West")]:
        for x in run_case(m, own, p, {"region": r}, "2024-01", tables, force=True).verdict.collect():
            y = got[f"{k}-{p}-{r}", x.driver]
            assert [y[c] for c in (*COLUMNS, "found_support")] == [x[c] for c in (*COLUMNS, "found_support")], (p, r, x.driver)
    path.write_text("SELECT account_id AS about FROM {footprint}")
    with pytest.raises(EvidenceError, match="footprints"):
        investigated(m, [own], _openings(spark, mine), tables)
    path.write_text("SELECT case_id, account_id AS about FROM {footprints}")
    with pytest.raises(EvidenceError, match="no column outcome"):
        investigated(m, [own], _openings(spark, mine), tables)


def _events(spark):
    rows = [(f"a{i % 3}" if i % 7 else None, datetime(2024, 1, 1) + timedelta(hours=11 * i) if i % 13 else None) for i in range(200)]
    return rows, spark.createDataFrame(rows, "k string, at timestamp_ntz")


def _windows(spark):
    day = date(2024, 1, 1)
    rows = [(f"a{i % 4}", day + timedelta(3 * i), day + timedelta(3 * i + [0, 1, 40, -1][i % 4]), i) for i in range(30)] + [("a1", None, day, 30), ("a1", day, None, 31), (None, day, day, 32)]
    return rows, spark.createDataFrame(rows, "k string, start date, end date, id int")


@pytest.mark.parametrize("skewed", [False, True])
@pytest.mark.parametrize("width", [1, 32])
def test_events_meet_their_windows(spark, monkeypatch, skewed, width):
    monkeypatch.setattr("tidemark.operators.intervals.HOT_ROWS", 0)  # all keys are hot
    events, e = _events(spark)
    windows, w = _windows(spark)
    start = lambda d: datetime(d.year, d.month, d.day)
    for closed in (False, True):
        want = sorted((i, t) for k, t in events for a, s, z, i in windows if k and k == a and t and s and z and s <= z and start(s) <= t and (t <= start(z) if closed else t < start(z)))
        df = within(e, w, ["k"], "at", closed=closed, skewed=skewed, width=width)
        assert sorted((r.id, r["at"]) for r in df.collect()) == want and want
    plan = within(e, w, ["k"], "at", skewed=skewed)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and all("Inner, (" in x or "LeftOuter, (" in x or "Cross" in x for x in plan.split("\n") if "Join" in x)
    if not skewed:
        assert "NestedLoop" not in within(e, w, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="both sides have"):
        within(e.withColumn("id", F.lit(1)), w, ["k"], "at")


@pytest.mark.parametrize("skewed", [False, True])
def test_intervals_meet_their_windows_once(spark, monkeypatch, skewed):
    monkeypatch.setattr("tidemark.operators.intervals.HOT_ROWS", 0)
    windows, w = _windows(spark)
    spans = [(f"a{i % 4}", datetime(2024, 1, 1) + timedelta(hours=31 * i), datetime(2024, 1, 1) + timedelta(hours=31 * i + 13 * (i % 90)) if i % 5 else None, i) for i in range(120)]
    df = spark.createDataFrame(spans, "k string, b timestamp_ntz, f timestamp_ntz, n int")
    start = lambda d: datetime(d.year, d.month, d.day)
    want = sorted((n, i) for k, b, f, n in spans for a, s, z, i in windows if k == a and s and z and s <= z and f and b < start(z) and f >= start(s))
    got = sorted((r.n, r.id) for r in overlapping(df, w, ["k"], "b", "f", skewed=skewed, width=8).collect())
    assert got == want and len(set(want)) == len(want) > 50


def test_spikes_of_many_windows(spark):
    days = spark.createDataFrame([("a", date(2024, 1, 5), 2), ("a", date(2024, 2, 1), 6), ("a", date(2024, 3, 1), 5), ("b", date(2024, 2, 2), 1)], "k string, day date, n long")
    windows = spark.createDataFrame([("a", 1, date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)), ("b", 1, date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)), ("a", 2, date(2024, 6, 1), date(2024, 7, 1), date(2024, 8, 1))], "k string, id int, baseline date, start date, end date")
    got = {(r.k, r.id): (r.window_count, r.baseline_count, r.ratio) for r in spike_counts(days, windows, ["k"]).collect()}
    assert got == {("a", 1): (6, 2, 3.0), ("b", 1): (1, 0, None)}

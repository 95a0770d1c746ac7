import dataclasses
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import band, crore, exact_sum, minutes_crossed, percent, quotes, scrubbed, tokens
from tidemark.operators.challenge import locality, timing
from tidemark.operators.conform import ConformanceError, conform_keys, fiscal_calendar, flag_tests
from tidemark.operators.decompose import contributions, covering, display, pair, tree
from tidemark.operators.entitle import NotEntitled, allowed, check_case, masked, statement
from tidemark.operators.evidence import EvidenceError, broken, probe, sql_probe, ticket_spike
from tidemark.operators.feedback import enumerated, promoted
from tidemark.operators.incremental import continued
from tidemark.operators.outcome import adjudicate, narrated, recommend
from tidemark.operators.scan import ScanError, closed_periods, sweep
from tidemark.operators.store import CaseStore, rollup
from tidemark.operators.verify import sparse, verify
from tidemark.plans.contract import Driver, Persona, contract_of
from tidemark.plans.formula import FormulaError
from tidemark.plans.gathered import gathered
from tidemark.plans.panel import Fact, Model, kpi_panel, sliceable
from tidemark.queries.outcome import CONTRACT
from tidemark.sources.raw import append_csv, build, connect, digest, exists, read_csv, read_documents, replaced, rewrite_csv, save, write_fixture
from tidemark.sources.star import CONTRACTS, CURRENT, FIRST, model
from tidemark.streaming.scheduled import on_arrival, stream_of, windowed_counts


def values(spark, column, *args):
    return [r[0] for r in spark.createDataFrame([(x,) for x in args], "x string").select(column(F.col("x"))).collect()]


def test_every_dimension_adds_up_to_the_whole(spark, sf):
    m = model(spark, sf)
    for name in ("net_sales", "discount_rate"):
        nodes = contributions(m, CONTRACTS[name], ["region", "segment", "account_id"], CURRENT, "2001-06")
        sums = [r.d for r in nodes.groupBy("dimension").agg(F.sum("delta").alias("d")).collect()]
        panel = {r.period: r.value for r in kpi_panel(m, CONTRACTS[name]).where(F.col("period").isin(CURRENT, "2001-06")).collect()}
        assert len(sums) == 3 and all(abs(s - (panel[CURRENT] - panel["2001-06"])) < 1e-6 * max(1, abs(panel[CURRENT])) for s in sums)


def test_keys_with_the_same_rows_tie(spark):
    def lines(rows):
        return spark.createDataFrame(rows, "account_id long, amount_net double, day string").withColumn("day", F.to_date("day")).coalesce(1)

    up = [(a, v, "2024-02-01") for a, vs in ((2, (0.1, 0.2, 0.3)), (1, (0.3, 0.2, 0.1)), (3, (0.1, 0.2, 0.3))) for v in vs]
    back = lines([(3, v, "2024-02-01") for v in (0.3, 0.2, 0.1)]).withColumnRenamed("amount_net", "amount")
    m = Model({"sales": Fact(lines(up), "day"), "refunds": Fact(back, "day")})
    nodes = contributions(m, CONTRACTS["net_sales"], ["account_id"], "2024-02", "2024-01")
    assert sorted((r.key, r.delta, r.share) for r in nodes.collect()) == [("1", 0.6, 0.5), ("2", 0.6, 0.5)]  # 3 sent all back
    assert sorted((r.key, r.share, r.n_keys) for r in display(nodes, 1).collect()) == [("1", 0.5, 1), ("others", 0.5, 1)]


def test_exact_sums(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [0.1] * 10, "b": [1e300, 1.0, -1e300], "c": [1.0, inf], "d": [inf, -inf], "e": [nan, 2.0], "f": [1e-20, 2e-20], "g": [None, None], "h": [None, 4.5], "i": [-1e15, 0.25, 1e15], "j": [1e17, 5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").coalesce(1)
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
    assert got["a"] == 1.0 and got["b"] == 1.0 and got["c"] == inf and got["d"] != got["d"] and got["e"] != got["e"]
    assert abs(got["f"] - 3e-20) < 1e-30 and got["g"] is None and got["h"] == 4.5 and got["i"] == 0.25 and got["j"] == 1e17 + 5


def test_children_cover_their_parent(spark, sf):
    rows = tree(model(spark, sf), CONTRACTS["net_sales"], ["region", "segment"], CURRENT, "2001-06").collect()
    top = {r.path[0]: r.delta for r in rows if r.depth == 1}
    for key in {r.path[0] for r in rows if r.depth == 2}:
        below = [r for r in rows if r.depth == 2 and r.path[0] == key]
        assert 0.8 <= sum(abs(r.delta) for r in below) / abs(top[key]) and all(abs(r.share - r.delta / top[key]) < 1e-9 for r in below)


def test_panel_errors(spark, sf):
    m = model(spark, sf)
    with pytest.raises(FormulaError):
        kpi_panel(m, CONTRACTS["net_sales"], ["colour"])
    with pytest.raises(FormulaError):
        kpi_panel(m, contract_of({"id": "x", "formula": "SUM(sales.qty)", "filters": ["lost.column = 1"], "materiality": {"relative": 0.1, "absolute": 1}}))
    for table in ("tickets", "customer"):  # a table that the formula doesn't read, of the model or not
        with pytest.raises(FormulaError):
            kpi_panel(m, contract_of({"id": "x", "formula": "SUM(sales.qty)", "filters": [f"{table}.category = 'x'"], "materiality": {"relative": 0.1, "absolute": 1}}))
    assert sliceable(m, CONTRACTS["net_sales"].parsed, "region") and not sliceable(m, CONTRACTS["net_sales"].parsed, "colour")


def test_verify_says_everything_of_each_slice(spark, sf):
    rows = verify(model(spark, sf), CONTRACTS["net_sales"], ["region"], CURRENT, FIRST).collect()
    assert len(rows) == 5 and all(r.passed == (r.status == "ok" and r.complete and not r.drifted and not r.artefact and r.material) for r in rows)


def test_an_early_verify_borrows_its_baseline(spark, sf):
    import dataclasses

    young = dataclasses.replace(CONTRACTS["gross_sales"], history_start=date(2001, 1, 1))
    rows = verify(model(spark, sf), young, ["region"], CURRENT, FIRST).collect()
    assert all(r.ceiling == "likely" and r.expected is not None for r in rows)


def test_history_is_sparse_by_days():
    year = contract_of({"id": "x", "formula": "SUM(sales.qty)", "history_start": "2023-01-01", "materiality": {"relative": 0.1, "absolute": 1}})
    assert not sparse(year, "2024-12") and sparse(year, "2024-11")
    import dataclasses

    assert sparse(dataclasses.replace(year, history_start=date(2023, 1, 3)), "2024-12") and not sparse(dataclasses.replace(year, history_start=date(2023, 1, 1), seasonal_period_days=365), "2025-01")


def small_world(spark, rows):
    """rows: account, region, day, amount."""
    accounts = spark.createDataFrame(sorted({(a, r) for a, r, *_ in rows}, key=str), "account_id string, region string")
    bills = spark.createDataFrame([(a, d, x) for a, _, d, x in rows], "account_id string, day date, x double").withColumn("came", F.col("day").cast("timestamp_ntz"))
    return Model({"bill": Fact(bills, "day", "came")}, accounts)


def test_medians_of_parts_are_their_own(spark):
    days = [date(2024, 1, 5), date(2024, 2, 5)]
    m = small_world(spark, [("a", "E", days[0], 20.0), ("b", "E", days[0], 22.0), ("a", "E", days[1], 30.0), ("b", "E", days[1], 32.0), ("c", "W", days[0], 7.0), ("c", "W", days[1], 7.0), ("d", "W", days[1], 9.0)])
    c = contract_of({"id": "m", "formula": "MEDIAN(bill.x)", "materiality": {"relative": 0.1, "absolute": 1}})
    got = {(r.dimension, r.key): (r.delta, r.share) for r in contributions(m, c, ["region", "account_id"], "2024-02", "2024-01").collect()}
    assert got["region", "E"] == (10.0, 10.0 / -0.5) and got["region", "W"] == (1.0, 1.0 / -0.5) and got["account_id", "d"][0] == 9.0 and ("account_id", "c") not in got
    paths = {"/".join(r.path): r.delta for r in tree(m, c, ["region", "account_id"], "2024-02", "2024-01").collect()}
    assert paths["E/a"] == 10.0 or paths["a/E"] == 10.0
    ratio = contract_of({"id": "r", "formula": "SUM(bill.x) / COUNT(bill.x)", "materiality": {"relative": 0.1, "absolute": 1}})
    nodes = {"/".join(r.path): (r.delta, r.depth) for r in tree(m, ratio, ["region", "account_id"], "2024-02", "2024-01").collect()}
    whole = 78 / 4 - 49 / 3
    assert abs(sum(d for d, depth in nodes.values() if depth == 1) - whole) < 1e-9


def test_a_slice_without_a_name_is_judged_like_others(spark):
    months = [date(2021 + i // 12, i % 12 + 1, 5) for i in range(36)]
    rows = [(a, r, d, x + (i % 3) + (900.0 if i == 35 else 0.0)) for a, r, x in (("a", "E", 1000.0), ("b", None, 1000.0)) for i, d in enumerate(months)]
    m = small_world(spark, rows)
    c = contract_of({"id": "m", "formula": "SUM(bill.x)", "history_start": "2021-01-01", "materiality": {"relative": 0.03, "absolute": 1.0, "min_persistence": 1}, "quality": {"max_single_record_share": 9.9}})
    got = {r.region: r for r in verify(m, c, ["region"], "2023-12", "2021-01").collect()}
    assert got.keys() == {"E", None} and all(r.passed and r.material and r.record_share > 1 for r in got.values())
    swept = sweep(m, [c], "2023-12", "2021-01").collect()
    assert [(r.region, r.status) for r in swept] == [("E", "open")]


def test_a_sweep_reads_the_records_once_a_table(spark, sf):
    m, read = model(spark, sf), []
    names = ["gross_sales", "net_sales", "discount_rate", "mean_quantity", "kept_share"]
    asked = gathered(m, [CONTRACTS[n] for n in names], ["region"]).rows
    leaves = asked._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [str(leaves.apply(i)) for i in range(leaves.size())]
    assert sum("l_orderkey" in x for x in read) == 2


def test_a_sweep_is_that_of_each_contract(spark, sf):
    m = model(spark, sf)
    names = ["net_sales", "discount_rate", "mean_quantity", "net_sales_redefined"]
    both = sorted(map(str, sweep(m, [CONTRACTS[n] for n in names], CURRENT, FIRST).collect()))
    assert both == sorted(str(r) for n in names for r in sweep(m, [CONTRACTS[n]], CURRENT, FIRST).collect())


def test_a_sweep_is_saved(spark, sf, tmp_path):
    store = CaseStore(spark, str(tmp_path / "cases"))
    m, c = model(spark, sf), [CONTRACTS["net_sales"]]
    with pytest.raises(ScanError, match="as_of"):
        sweep(m, c, CURRENT, FIRST, store=store)
    for n in (1, 2):  # one time for both: the second's versions are the next ones
        swept = sweep(m, c, CURRENT, FIRST, as_of=datetime(2001, 9, 1), store=store).collect()
        kept = store.cases().collect()
        assert sorted(r.case_id for r in kept) == sorted(r.case_id for r in swept) and {r.version for r in kept} == {n} and len(swept) == 5
    totals = rollup(store.cases()).first()
    assert totals.n_cases == 5 and totals.n_needs_decision == 0


def test_a_replacement_that_breaks_off_is_taken_up_again(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda n, to: spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(f"{path}{to}")
    put(1, ".old")  # broke off between the two renames
    put(2, ".new")
    assert exists(spark, path) and spark.read.parquet(path).first().n == 1
    replaced(spark, path)
    assert spark.read.parquet(path).first().n == 2 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    with pytest.raises(OSError):  # there is no new one: what was there stays whole
        replaced(spark, path)
    assert exists(spark, path) and spark.read.parquet(path).first().n == 2


def test_a_source_without_a_watermark_is_an_error(spark):
    marks = spark.createDataFrame([("billing", datetime(2024, 4, 30, 9)), ("crm", datetime(2024, 4, 29)), ("ops", None)], "source string, watermark timestamp_ntz")
    of = lambda s: contract_of({"id": s, "formula": "SUM(a.x)", "source": s, "refresh": {"source": s}, "materiality": {"relative": 0.1, "absolute": 1.0}})
    c = [dataclasses.replace(of(s), source=s) for s in ("billing", "crm", "ops", "none")]
    assert closed_periods(marks, c[:2]) == {"billing": "2024-04", "crm": "2024-03"}
    for broken in c[2:]:
        with pytest.raises(ScanError, match="no watermark"):
            closed_periods(marks, [broken])


def test_periods_reach_the_scan(spark, sf):
    plan = pair(model(spark, sf), CONTRACTS["net_sales"], ["region"], CURRENT, "2001-06")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,2001-06-01T00:00)" in plan


def test_covering_keys_in_steps(spark):
    rng = random.Random(4)
    rows = [(g, f"k{i}", float(rng.choice([-1, 1]) * rng.choice([5, 5, 5, rng.randint(0, 400)]))) for g in "ab" for i in range(300)]
    got = {(r.dimension, r.key) for r in covering(spark.createDataFrame(rows, "dimension string, key string, delta double"), ["dimension"]).collect()}
    want = set()
    for g in "ab":
        mine, total, before = sorted((r for r in rows if r[0] == g and r[2]), key=lambda r: (-abs(r[2]), r[1])), sum(abs(r[2]) for r in rows if r[0] == g), 0.0
        for r in mine:
            if before / total < 0.8:
                want.add(r[:2])
            before += abs(r[2])
    assert got == want


def test_columns(spark):
    assert values(spark, lambda x: band(x.cast("double")), "0", "-12000000", "49999999", "50000000", "250000000", "-1e9", None) == ["under ₹1 Cr", "−₹1–5 Cr", "₹1–5 Cr", "₹5–25 Cr", "₹25–100 Cr", "−over ₹100 Cr", None]
    assert values(spark, lambda x: crore(x.cast("double")), "-26642279", "0", None) == ["−₹2.7 Cr", "₹0.0 Cr", None]
    assert values(spark, lambda x: percent(x.cast("double")), "-0.0814", "0.5") == ["−8.1%", "50.0%"] and values(spark, lambda x: percent(x.cast("double"), 0), "0.256") == ["26%"]
    assert values(spark, tokens, "The competitors' stories, running deferred; it is 24/7 classes", None) == [["competitors'", "story", "run", "defer", "24", "7", "class"], []]
    assert values(spark, lambda x: scrubbed(x, ["Acme", "Acme Corp (EU)"]), "acme corp (eu) and ACME paid 1,200.50 or 54321 in 2026-04") == ["[restricted] and [restricted] paid [amount restricted] or [amount restricted] in 2026-04"]
    assert values(spark, lambda x: quotes(x, F.lit(" two  words ")), "has two\n words", "has twowords", None) == [True, False, None]
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert spark.range(1).select(minutes_crossed(ts("2024-01-01 10:00:59"), ts("2024-01-01 10:01:00"))).first()[0] == 1


def test_conformance(spark):
    alias = spark.createDataFrame([("billing", "B1", "A1"), ("crm", "B2", "A2")], "source string, raw_id string, account_id string")
    raw = spark.createDataFrame([("B1", 1), ("B2", 2)], "account_id string, n int")
    with pytest.raises(ConformanceError):
        conform_keys(raw, alias, "billing")
    assert {(r.source_account_id, r.account_id) for r in conform_keys(raw, alias, "billing", required=False).collect()} == {("B1", "A1"), ("B2", None)}
    with pytest.raises(ConformanceError):
        flag_tests(alias.select("account_id"), spark.createDataFrame([("A9",)], "account_id string"))
    days = {r.day: r for r in fiscal_calendar(spark, date(2023, 3, 27), date(2024, 3, 25)).collect()}
    assert days[date(2023, 3, 27)].period_label == "FY2024-P01" and days[date(2023, 5, 21)].period_label == "FY2024-P02" and days[date(2023, 5, 22)].period_label == "FY2024-P03"
    assert (days[date(2024, 3, 24)].fiscal_week, days[date(2024, 3, 25)].period_label) == (52, "FY2025-P01")


def test_timing_and_locality(spark):
    causes = spark.createDataFrame([("a", date(2024, 1, 1), 30), ("b", date(2024, 1, 20), 30), ("c", None, 30)], "driver string, onset date, max_lag_days int")
    effects = spark.createDataFrame([(d, "x", date(2024, 1, 10)) for d in "abc"] + [(d, "y", date(2024, 1, 30)) for d in "abc"], "driver string, account_id string, effect_on date")
    assert {r.driver: (r.worst_lag, r.outcome) for r in timing(causes, effects).collect()} == {"a": (29, "pass"), "b": (-10, "refute"), "c": (None, "inconclusive")}
    where = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("n", None)], "driver string, account_id string")
    effect = spark.createDataFrame([("x",), ("y",)], "account_id string")
    assert {r.driver: (r.overlap, r.outcome) for r in locality(where, effect).collect()} == {"a": (1.0, "pass"), "b": (0.0, "refute"), "n": (0.0, "refute")}


def case(spark, **outcomes):
    rows = [(1, d, *o, False, False, None, 80.0, 100.0, None) for d, o in outcomes.items()]
    return adjudicate(spark.createDataFrame(rows, "case_id int, driver string, timing string, locality string, dose string, control string, found_support boolean, unmodelled boolean, ceiling string, footprint_delta double, total_delta double, price_effect double"), ["case_id"])


def test_verdicts(spark):
    p, i, r = "pass", "inconclusive", "refute"
    got = lambda **o: {x.driver: (x.confidence, x.status) for x in case(spark, **o).collect()}
    assert got(a=(p, p, p, p), b=(r, p, p, p)) == {"a": ("confirmed", "primary"), "b": ("confirmed", "eliminated")}
    assert got(a=(p, i, p, i)) == {"a": ("likely", "primary")}
    assert got(a=(i, i, p, p)) == {"a": ("undetermined", "unresolved")}
    assert got(a=(p, p, p, p), b=(p, p, i, i)) == {"a": ("contested", "unresolved"), "b": ("contested", "unresolved")}
    row = recommend(case(spark, integration=(p, p, p, p)), CONTRACT, F.lit("A1, A2")).first()
    assert (row.action, row.impact_low, row.impact_high) == ("Prioritise the integration fix for A1, A2.", 75.0, 100.0)


def test_entitlement(spark):
    vp = Persona("v", "vp_sales", "VP", "EUROPE")
    assert allowed(CONTRACT, vp, "region") == ["EUROPE"] and allowed(CONTRACT, Persona("c", "cfo"), "region") is None and allowed(CONTRACT, Persona("g", "guest"), "region") == []
    with pytest.raises(NotEntitled):
        check_case(CONTRACT, vp, {"region": "ASIA"})
    df = spark.createDataFrame([("A1", "Acme", 2e7, "Acme paid 123456")], "account_id string, name string, amount double, claim string")
    seen = masked(df, CONTRACT, vp, {"name": "account_id"}, ["amount"], ["claim"], ["Acme"]).first()
    assert seen.name.startswith("Account ") and seen.amount == "₹1–5 Cr" and seen.claim == "[restricted] paid [amount restricted]"
    assert masked(df, CONTRACT, Persona("c", "cfo"), {"name": "account_id"}, ["amount"], ["claim"], ["Acme"]).first() == df.first()
    assert statement([]) == "No redactions: this view is complete." and "2 row values of region" in statement([("row", "region", 2)])


def test_narration():
    facts = {"kpi": "Net", "delta_pct": "−8.0%", "delta": "−1", "period": "2026-04"}
    assert narrated("headline", "{kpi} fell {delta_pct} [ev-a-timing-001].", facts, {"ev-a-timing-001"}) == "Net fell −8.0% [ev-a-timing-001]."
    fallback = "Net moved −8.0% (−1) in 2026-04."
    for bad in ("fell by 8", "{unknown}", "{kpi} [ev-x-1]", " "):
        assert narrated("headline", bad, facts, {"ev-a-timing-001"}) == fallback


def test_evidence_and_feedback(spark):
    items = [("a", "checked_absent", None, None, "probe", None), ("b", "uncheckable", None, None, "probe", None), ("c", "found", 1, None, "extraction", ""), ("d", "found", 1, None, "probe", None), ("d", "found", 1, None, "probe", None)]
    assert {r.id for r in broken(spark.createDataFrame(items, "id string, outcome string, denominator int, coverage double, method string, quote string")).collect()} == {"a", "b", "c", "d"}
    with pytest.raises(EvidenceError):
        probe("unknown")
    notes = enumerated(CONTRACT, [{"driver": "season", "rationale": "x"}, {"driver": "season", "rationale": "y"}, {"driver": "unmodelled"}, {"driver": "bogus"}])
    assert [n["driver"] for n in notes] == ["integration", "pricing_change", "season", "unmodelled"] and notes[2]["rationale"] == "x"
    bogus = enumerated(CONTRACT, [{"driver": "bogus", "rationale": "b"}, {"driver": "other", "rationale": "o"}])
    assert bogus[-1] == {"driver": "unmodelled", "priority": 4, "rationale": "b"} and len(bogus) == 4
    assert promoted(CONTRACT, Driver("new")).drivers[-1].id == "new"
    with pytest.raises(ValueError):
        promoted(CONTRACT, Driver("season"))


def test_case_store(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "cases"))
    with pytest.raises(FileNotFoundError):
        store.cases()
    rows = lambda *r: spark.createDataFrame(r, "case_id string, updated_at timestamp_ntz, version long, priority double, status string")
    store.save(rows(("a", datetime(2024, 1, 1), 1, 5.0, "open"), ("b", datetime(2024, 1, 1), 1, 9.0, "open")))
    store.save(rows(("a", datetime(2024, 1, 2), 2, 7.0, "closed")))
    store.save(rows(("a", datetime(2024, 1, 2), 2, 7.0, "closed")))
    for _ in range(2):
        assert [(r.case_id, r.priority) for r in store.cases().collect()] == [("b", 9.0), ("a", 7.0)]
        assert [r.case_id for r in store.cases(open_only=True).collect()] == ["b"] and store.load("a").first().status == "closed"
        store.compact()


def test_files(spark, tmp_path):
    schema = "k string, v int, at timestamp_ntz"
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_csv(spark, path, schema)
    df = spark.createDataFrame([("a", 1, datetime(2024, 1, 1, 6)), (None, None, None)], schema)
    append_csv(df, path)
    append_csv(df, path)
    back = read_csv(spark, path, schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect() * 2))
    rewrite_csv(back.where("k = 'a'").withColumn("v", F.lit(2)), path)
    assert [r.v for r in read_csv(spark, path, schema).collect()] == [2, 2]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a replacement that broke off
    assert [r.v for r in read_csv(spark, path, schema).collect()] == [2, 2] and not (tmp_path / "t.old").exists()
    assert digest(df).first() == digest(df.orderBy("k")).first() != digest(read_csv(spark, path, schema)).first()


def test_fixtures_are_the_same_however_they_are_dealt(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.5, True, datetime(2024, 1, 1, 6)), ("a", 1, 1e-7, False, None), (None, None, None, None, None), ('x,"y"\n', 3, 2.0, None, datetime(2024, 1, 1, 6, 0, 0, 5))], "k string, v int, d double, f boolean, at timestamp_ntz")
    one, two = (write_fixture({"raw/t": part, "none": df.where("false")}, tmp_path / str(n)) for n, part in enumerate((df.repartition(3, "k"), df.coalesce(1).orderBy(F.desc("v")))))
    assert one == two and one.keys() == {"raw/t", "none"}
    text = (tmp_path / "0" / "raw" / "t.csv").read_text()
    assert text.startswith("k,v,d,f,at\n,,,,\na,1,1e-07,false,\nb,2,0.5,true,2024-01-01 06:00:00\n") and (tmp_path / "0" / "none.csv").read_text() == "k,v,d,f,at\n"
    assert (tmp_path / "1" / "manifest.sha256").read_text() == "".join(f"{one[n]}  {n}.csv\n" for n in sorted(one))


def test_probes_of_sql_files(spark, tmp_path):
    file = tmp_path / "quiet.sql"
    file.write_text("""-- Tickets of a footprint in a window, and before it.
SELECT account_id, count_if(created_at >= :start) AS window_count, count_if(created_at < :start) AS baseline_count
FROM {ticket} WHERE account_id IN (SELECT account_id FROM {accounts}) AND created_at >= :before AND created_at < :end
GROUP BY account_id;
""")
    ticket = spark.createDataFrame([("A", datetime(2024, 1, d)) for d in range(1, 20)] + [("B", datetime(2024, 1, 12)), ("C", datetime(2024, 1, 12))], "account_id string, created_at timestamp_ntz")
    tables = {"ticket": ticket, "accounts": spark.createDataFrame([("A",), ("B",), ("B",)], "account_id string")}
    at = {"before": date(2024, 1, 2), "start": date(2024, 1, 11), "end": date(2024, 1, 16)}
    got = sql_probe(spark, str(file), tables, at)
    want = ticket_spike(ticket, tables["accounts"], "2024-01-11", "2024-01-16", "2024-01-02", "2024-01-11")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r)[:3] for r in want.collect()) == [("A", 5, 9), ("B", 1, 0)]
    for lacking in (lambda: sql_probe(spark, str(file), {"ticket": ticket}, at), lambda: sql_probe(spark, str(file), tables, {"start": at["start"]}), lambda: sql_probe(spark, str(tmp_path / "none.sql"), tables, at)):
        with pytest.raises(EvidenceError):
            lacking()


def test_documents_with_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ndoc_id: D1\ntable: ticket\ndate: 2024-01-01\nrole: signal: strong\n---\nBody\n\ntext.\n")
    r = read_documents(spark, f"file://{tmp_path}/*.md").first()
    assert r.fields == {"doc_id": "D1", "table": "ticket", "date": "2024-01-01", "role": "signal: strong"} and r.body == "Body\n\ntext."
    (tmp_path / "b.md").write_text("---\ndoc_id: D1\ntable: t\ndate: d\nrole: r\n---\nx")
    with pytest.raises(ValueError, match="twice"):
        read_documents(spark, f"file://{tmp_path}/*.md")
    (tmp_path / "b.md").write_text("---\ndoc_id: D2\n---\nx")
    with pytest.raises(ValueError, match="lacks"):
        read_documents(spark, f"file://{tmp_path}/*.md")


def test_a_warehouse_of_raw_files(spark, tmp_path):
    from tidemark.sources.raw import TABLES

    rows = {
        "account": ["ACC-1,Acme,East,smb,tech,u,2023-04-01,c,2024-02-01 00:00:00", "ACC-2,Test,West,smb,tech,u,2023-04-01,c,2024-02-01 00:00:00"],
        "invoice_line": ["I1,1,2024-01-10,B-1,P1,North,2,50.0,100.0,0.0,100.0,INR,1,,,2024-01-11 00:00:00", "I2,1,2024-01-10,B-2,P1,West,1,70.0,70.0,0.0,70.0,INR,0,,,2024-01-11 00:00:00"],
        "credit_note": ["C1,2024-01-20,I1,B-1,30.0,r,2024-01-21 00:00:00"],
    }
    for source, tables in TABLES.items():
        (tmp_path / source).mkdir()
        for t, ddl in tables.items():
            head = ",".join(c.split()[0] for c in ddl.split(", "))
            (tmp_path / source / f"{t}.csv").write_text("\n".join([head, *rows.get(t, [])]) + "\n")
    alias = spark.createDataFrame([("billing", "B-1", "ACC-1"), ("billing", "B-2", "ACC-2")], "source string, raw_id string, account_id string")
    w = build(spark, str(tmp_path), alias, spark.createDataFrame([("ACC-2",)], "account_id string"), datetime(2024, 2, 2), (date(2023, 3, 27), date(2025, 3, 26)))
    assert w.overrides.first().overridden == 1
    c = contract_of({"id": "net", "formula": "SUM(invoice_line.amount_net) - SUM(credit_note.amount)", "filters": ["invoice_line.account_id NOT IN (SELECT account_id FROM test_account)", "invoice_line.currency = 'INR'"], "materiality": {"relative": 0.1, "absolute": 1}})
    assert [(r.period, r.region, r.value) for r in kpi_panel(w.model(), c, ["region"]).collect()] == [("2024-01", "East", 70.0)]
    assert [(r.period, r.value) for r in kpi_panel(w.model(), c, fiscal=True).collect()] == [("FY2024-P10", 70.0)]
    assert {(r.source, r.n_rows) for r in w.watermark.collect()} == {("billing", 3), ("crm", 2), ("product_ops", 0)}
    c2 = kpi_panel(w.model(), c, ["region"]).collect()
    with pytest.raises(FileNotFoundError):
        connect(spark, str(tmp_path / "saved"))
    for _ in range(2):  # a rebuild takes the place of what is there
        save(w, str(tmp_path / "saved"))
    back = connect(spark, str(tmp_path / "saved"))
    assert back.as_of == w.as_of and back.tables.keys() == w.tables.keys() and kpi_panel(back.model(), c, ["region"]).collect() == c2
    assert not {f.name for f in tmp_path.iterdir()} & {"saved.new", "saved.old"}
    assert all(sorted(map(str, back.tables[t].collect())) == sorted(map(str, w.tables[t].collect())) for t in w.tables)
    pushed = back.tables["invoice_line"].where("invoice_date BETWEEN date'2024-01-01' AND date'2024-01-31'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(invoice_date" in pushed
    again = [continued(w.tables["invoice_line"], 7).orderBy("invoice_id").collect() for _ in range(2)]
    assert again[0] == again[1] and [(str(r.invoice_date), r.is_recurring) for r in again[0]] == [("2024-02-10", 1), ("2024-02-10", 0)] and again[0][0].amount_net == 100.0


def test_a_stream_feeds_and_reruns(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder, seen = str(tmp_path / "events"), []
    events.repartition(4).write.parquet(folder)
    on_arrival(stream_of(spark, folder, 2), lambda df, v: seen.append((v, df.count())), str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 2 and sum(n for _, n in seen) == events.count()
    out = str(tmp_path / "out")
    query = windowed_counts(stream_of(spark, folder)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    streamed, batch = spark.read.parquet(out), windowed_counts(events)
    assert streamed.count() > 0 and streamed.select("start", "event_type", "n").exceptAll(batch.select("start", "event_type", "n")).count() == 0

import dataclasses
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.provider import CacheMiss, Replay, Stub, Usage
from tidemark.operators.causes import Footprint
from tidemark.operators.entitle import NotEntitled
from tidemark.operators.evidence import EvidenceError
from tidemark.operators.incremental import next_batch
from tidemark.operators.investigate import aliased, extracted, replayed, run_case, told
from tidemark.operators.outcome import incoherent, menu, page, report, undecided
from tidemark.operators.probes import evidence
from tidemark.operators.scan import scan
from tidemark.operators.store import CaseStore, rollup
from tidemark.plans.contract import Access, Driver, Persona, contract_of
from tidemark.plans.panel import Fact, Model
from tidemark.sources.star import CONTRACTS, FIRST, model
from tidemark.streaming.scheduled import repeated


@pytest.fixture(scope="module")
def world(spark):
    """Twelve accounts of one region and segment; two lose their revenue in 2024-03, after tickets that pile up from February on."""
    accounts = spark.createDataFrame([(f"A{i:02d}", "East", "smb", date(2020, 1, 1)) for i in range(12)] + [("B01", "West", "smb", date(2020, 1, 1))], "account_id string, region string, segment string, first_contract_date date")
    months = [f"{y}-{m:02d}" for y in (2022, 2023, 2024) for m in range(1, 13) if (y, m) <= (2024, 3)]
    lost = {"A00": 900.0, "A01": 800.0}
    bills = [(f"A{i:02d}", date.fromisoformat(f"{m}-05"), 1000.0 + i + (j % 3) - lost.get(f"A{i:02d}", 0.0) * (m == "2024-03")) for i in range(12) for j, m in enumerate(months)]
    invoice = spark.createDataFrame(bills, "account_id string, invoice_date date, amount_net double").withColumn("_ingested_at", F.col("invoice_date").cast("timestamp_ntz"))
    ticket = []
    for i in range(12):
        for day in range(1, 32):
            n = 6 if i < 2 and day >= 10 else 1
            ticket += [(f"A{i:02d}", datetime(2024, 3, day, 10))] * n
        for day in range(1, 30):
            ticket += [(f"A{i:02d}", datetime(y, m, day, 10)) for y, m in ((2024, 2), (2024, 1), (2023, 12))]
    tables = {
        "account": accounts,
        "ticket": spark.createDataFrame(ticket, "account_id string, created_at timestamp_ntz"),
        "renewal": spark.createDataFrame([("A00", date(2024, 3, 20)), ("A01", date(2024, 3, 25))], "account_id string, closed_date date"),
        "price_book": spark.createDataFrame([("enterprise", date(2024, 2, 1))], "segment string, effective_from date"),
        "news_item": spark.createDataFrame([(datetime(2024, 2, 1), "Rival", "West")], "published_at timestamp_ntz, competitor string, region string"),
        "incident": spark.createDataFrame([], "incident_id string, service string, started_at timestamp_ntz, resolved_at timestamp_ntz, severity string, affected_accounts string"),
    }
    contract = contract_of(
        {
            "id": "revenue", "formula": "SUM(invoice.amount_net)", "owner_role": "cfo", "materiality": {"relative": 0.03, "absolute": 100.0, "min_persistence": 1},
            "quality": {"max_single_record_share": 0.9}, "history_start": "2022-01-01",
            "drivers": [
                {"id": "integration", "probe": "ticket_spike", "max_lag_days": 45, "lever": {"action": "prioritise_integration_fix", "owner_role": "eng", "save_rate": [0.5, 1.0]}},
                {"id": "pricing", "probe": "price_delta", "max_lag_days": 60},
                {"id": "offer", "probe": "lost_reason_scan", "max_lag_days": 90},
                {"id": "supply", "probe": "incident_scan", "max_lag_days": 30},
                {"id": "season"},
            ],
        }
    )
    return Model({"invoice": Fact(invoice, "invoice_date", "_ingested_at")}, accounts), contract, tables


def test_a_case_finds_its_cause(world):
    m, contract, tables = world
    case = run_case(m, contract, "2024-03", {"region": "East"}, "2022-01", tables)
    assert "closed" not in case.notes
    assert {r.account_id for r in case.footprint.collect()} == {"A00", "A01"}
    tests = {r.driver: r for r in case.matrix.collect()}
    assert tests.keys() == {"integration", "pricing", "offer", "supply"}
    assert (tests["integration"].timing, tests["integration"].locality, tests["integration"].dose, tests["integration"].control) == ("pass", "pass", "inconclusive", "pass")
    assert tests["pricing"].locality == "refute" and tests["pricing"].timing == "inconclusive" and tests["offer"].locality == "refute" and tests["supply"].locality == "inconclusive"
    best = case.verdict.where("rank = 1").first()
    assert (best.driver, best.status, best.confidence) == ("integration", "primary", "likely") and best.share > 0.9
    assert case.recommendation.first().action == "Prioritise the integration fix for A00, A01."
    assert case.question.first().owner_role == "eng"
    assert all(r.account.startswith("Account ") for r in aliased(case.footprint).collect())


def test_what_probes_found_is_in_the_ledger(spark, world):
    m, contract, tables = world
    at = Footprint(spark.createDataFrame([("A00",), ("A01",)], "account_id string"), date(2024, 2, 1), date(2024, 3, 31))
    got = {r.id: r for r in evidence(tables, [d for d in contract.drivers if d.probe], at).collect()}
    assert got["ev-integration-A00"].supports == "integration" and "ev-pricing-smb" not in got
    assert (got["ev-offer-lost_reason_scan"].outcome, got["ev-offer-lost_reason_scan"].coverage) == ("uncheckable", 0.0)
    lost = spark.createDataFrame([("A00", 0, date(2024, 3, 5), "competitor_price"), ("A01", 0, date(2024, 3, 6), None), ("A01", 1, date(2024, 3, 6), None)], "account_id string, closed_won int, close_date date, lost_reason_code string")
    more = tables | {
        "opportunity": lost,
        "price_book": spark.createDataFrame([("smb", date(2023, 1, 1)), ("smb", date(2024, 3, 1))], "segment string, effective_from date"),
        "incident": spark.createDataFrame([("I1", "api", datetime(2024, 3, 1), datetime(2024, 3, 2), "high", "A09|A10")], "incident_id string, service string, started_at timestamp_ntz, resolved_at timestamp_ntz, severity string, affected_accounts string"),
    }
    got = {r.id: (r.outcome, r.supports, r.contradicts, r.strength, r.denominator) for r in evidence(more, [d for d in contract.drivers if d.probe], at).collect()}
    assert got["ev-offer-lost_reason_code"] == ("found", "offer", None, 1.0, None)
    assert got["ev-pricing-smb"] == ("found", "pricing", None, 0.8, None)
    assert got["ev-supply-incident"] == ("checked_absent", None, "supply", 0.5, 1)
    with pytest.raises(EvidenceError):
        evidence(more, [Driver("x", probe="nothing")], at)


def test_a_contract_may_have_a_probe_of_its_own(spark, world, tmp_path):
    m, contract, tables = world
    path = tmp_path / "busy.sql"
    path.write_text("SELECT account_id AS about, 'found' AS outcome, count(*) > 100 AS supported, 0.7 AS strength, NULL AS denominator, concat(account_id, ': ', count(*)) AS claim FROM {ticket} JOIN {footprint} USING (account_id) WHERE created_at >= :start AND created_at < :end GROUP BY account_id")
    own = dataclasses.replace(contract, drivers=(*contract.drivers, Driver("busy", probe=str(path), max_lag_days=10)))
    case = run_case(m, own, "2024-03", {"region": "East"}, "2022-01", tables)
    items = {r.id: r for r in case.evidence.where("driver = 'busy' AND method = 'sql'").collect()}
    assert {i: (r.outcome, r.supports, r.strength, r.claim) for i, r in items.items()} == {f"ev-busy-{a}": ("found", "busy", 0.7, f"{a}: 164") for a in ("A00", "A01")}
    assert {r.driver for r in case.matrix.collect()} == {"integration", "pricing", "offer", "supply", "busy"}
    path.write_text("SELECT 1 AS about FROM {ticket}")
    with pytest.raises(EvidenceError, match="no column outcome"):
        evidence(tables, [Driver("busy", probe=str(path))], Footprint(spark.createDataFrame([("A00",)], "account_id string"), date(2024, 2, 1), date(2024, 3, 31)))


def test_runs_are_repeated_with_a_wait_between():
    waits = []
    assert list(repeated(lambda n: n * 10, timedelta(hours=6), 3, waits.append)) == [0, 10, 20] and waits == [21600.0, 21600.0]
    assert list(repeated(lambda n: n, timedelta(1), 0, waits.append)) == [] and next(repeated(lambda n: n, timedelta(1), wait=waits.append)) == 0


def test_a_minor_price_cause_has_its_share(spark, world):
    """One account's price falls a little beside the loss that a cause explains: support was found for it, though a test refutes it."""
    m, contract, tables = world
    bills = m.facts["invoice"].df.withColumn("product_id", F.lit("P")).withColumn("qty", F.lit(10.0))
    priced = dataclasses.replace(m, facts={"invoice": Fact(bills, "invoice_date", "_ingested_at")})
    tables = tables | {
        "price_book": spark.createDataFrame([("smb", date(2024, 3, 1))], "segment string, effective_from date"),
    }
    case = run_case(priced, contract, "2024-03", {"region": "East"}, "2022-01", tables, provider=Stub({"hypotheses": [{"driver": "integration", "rationale": "tickets"}]}))
    got = {r.driver: r for r in case.verdict.collect()}
    assert got["pricing"].status == "minor" and got["pricing"].price_effect is not None
    assert got["pricing"].share == pytest.approx(got["pricing"].price_effect / got["pricing"].total_delta)
    assert case.hypotheses[0]["rationale"] == "tickets" and {r.stage for r in case.telemetry.collect()} == {"verify", "decompose", "hypothesise", "probe", "extract", "challenge", "adjudicate"}
    odd = run_case(priced, contract, "2024-03", {"region": "East"}, "2022-01", tables, provider=Stub({"hypotheses": [{"driver": "sunspots"}]}))
    assert odd.hypotheses[-1]["driver"] == "unmodelled" and {r.confidence for r in odd.verdict.collect()} == {"undetermined"}


def test_a_case_is_told_by_what_a_viewer_may_see(world):
    m, contract, tables = world
    access = {"row": {"region": {"cfo": ["*"], "lead": ["own_region"]}}, "column": {"account_name": ["cfo"], "amount_net": ["cfo"]}, "domain": {"segment": {"lead": ["mid"]}}}
    open_to = dataclasses.replace(contract, access=Access(**access))
    case = run_case(m, open_to, "2024-03", {"region": "East"}, "2022-01", tables)
    cfo, lead, west = Persona("c", "cfo"), Persona("l", "lead", "Lead", "East"), Persona("w", "lead", "Lead", "West")
    sections, nodes, said = told(case, open_to, cfo, {"region": "East"}, "2024-03", accounts=m.accounts, domain="segment")
    assert "A00" in sections["action"] and said.startswith("No redactions") and nodes.where("dimension = 'account_id'").count() > 2
    sections, nodes, said = told(case, open_to, lead, {"region": "East"}, "2024-03", Stub({"headline": "{kpi} lost {delta} in {period}", "explanation": "It lost 1700."}), accounts=m.accounts, domain="segment")
    assert "A00" not in sections["action"] and sections["headline"] == "Revenue lost −under ₹1 Cr in 2024-03" and "1700" not in sections["explanation"]
    assert "segment" in said and "account_name" in said and "amount_net" in said
    assert [r.key for r in nodes.where("dimension = 'account_id'").collect()] and "restricted" in nodes.where("dimension = 'account_id'").first().key
    with pytest.raises(NotEntitled):
        told(case, open_to, west, {"region": "East"}, "2024-03")


def test_any_item_of_a_large_ledger_may_be_cited(spark, world):
    m, contract, tables = world
    case = run_case(m, contract, "2024-03", {"region": "East"}, "2022-01", tables)
    many = dataclasses.replace(case, evidence=spark.range(1500).selectExpr("concat('ev-integration-', id) AS id"))
    say = lambda i: told(many, contract, Persona("c", "cfo"), {"region": "East"}, "2024-03", Stub({"explanation": f"Tickets piled up [ev-integration-{i}]."}))[0]["explanation"]
    assert all(say(i).startswith(f"Tickets piled up [ev-integration-{i}].") for i in (0, 1499))
    assert say(1500).startswith("Confidence: Likely.") and "1500" not in say(1500)


def test_a_scan_investigates_what_it_opens(spark, world, tmp_path):
    m, contract, tables = world
    store, as_of = CaseStore(spark, str(tmp_path / "cases")), datetime(2024, 4, 2)
    contract = dataclasses.replace(contract, source="billing")
    marks = spark.createDataFrame([("billing", datetime(2024, 3, 31, 12))], "source string, watermark timestamp_ntz")
    for version in (1, 2):
        cases, verdicts = scan(m, [contract], "2022-01", tables, marks, as_of, store=store)
        got = {r.region: (r.status, r.driver, r.confidence) for r in cases.collect()}
        assert got == {"East": ("open", "integration", "likely"), "West": ("unverifiable", None, None)}
        assert {r.driver for r in verdicts.collect()} == {"integration", "pricing", "offer", "supply"}
        kept = {r.region: r for r in store.cases().collect()}
        assert {r.version for r in kept.values()} == {version} and kept["East"].confidence == "likely" and kept["East"].priority > 0
    totals = rollup(store.cases()).first()
    assert (totals.n_cases, totals.n_open, totals.n_needs_decision) == (2, 1, 0) and totals.open_delta == pytest.approx(abs(kept["East"].delta))


def test_quotes_that_arent_in_their_document_are_dropped(spark, world):
    m, contract, tables = world
    tickets = spark.createDataFrame([("T1", "A00", datetime(2024, 3, 2), "Integration", "the integration  is late again"), ("T2", "A01", datetime(2024, 3, 3), "Other", "integration works")], "ticket_id string, account_id string, created_at timestamp_ntz, subject string, body_text string")
    more = {"ticket": tickets, "ticket_message": spark.createDataFrame([], "message_id string, ticket_id string, author_user_id string, created_at timestamp_ntz, body_text string")}
    at = Footprint(spark.createDataFrame([("A00",), ("A01",)], "account_id string"), date(2024, 2, 1), date(2024, 3, 31))
    said = Stub({"claims": [{"doc_id": "T1", "quote": "integration is late"}, {"doc_id": "T2", "quote": "is late"}, {"doc_id": "T9", "quote": "x"}]})
    found, used = extracted(more, [Driver("integration", evidence_sources=("tickets",), max_lag_days=45)], at, said)
    assert found == [("ev-integration-doc-001", "integration", "T1", "integration is late")] and len(used) == 1


def test_pages_say_what_keeps_a_case_open():
    case = {"kpi": "net_sales", "period": "2024-03", "delta": -2.5e7, "relative": -0.08, "confidence": "contested", "causes": [{"driver": "price_change", "status": "unresolved", "share": 0.4, "timing": "pass", "locality": "inconclusive"}, {"driver": "b", "status": "eliminated", "timing": "refute"}]}
    c = contract_of({"id": "net_sales", "formula": "SUM(a.x)", "materiality": {"relative": 0.1, "absolute": 1}, "access": {"column": {"amount_net": ["cfo"]}}})
    assert undecided(case) == "price change: the test of locality could not decide" and undecided(case | {"confidence": "likely"}) == ""
    assert menu(case, c, Persona("c", "cfo"))["delta"] == "−₹2.5 Cr" and menu(case, c, Persona("v", "vp"))["delta"] == "−₹1–5 Cr"
    assert page(case, c, Persona("c", "cfo"), {}, set())["explanation"].endswith("Not decided: price change: the test of locality could not decide.")


def test_verdicts_that_contradict_themselves(spark):
    rows = [("a", "likely", "primary"), ("b", "likely", "eliminated"), ("c", "contested", "primary"), ("d", "undetermined", "unresolved"), ("e", "undetermined", "unresolved")]
    df = spark.createDataFrame(rows, "case_id string, confidence string, status string")
    assert {r.case_id for r in incoherent(df).collect()} == {"b", "c"}
    assert {r.case_id for r in incoherent(df, df.where("case_id = 'e'")).collect()} == {"b", "c", "d"}
    assert "verdict likely" in report({"case_id": "x", "kpi": "k", "period": "p", "delta": 1.0, "relative": 0.1, "confidence": "likely", "priority": 2.0, "causes": [{"status": "primary", "driver": "d", "share": 0.5}]})


def test_a_case_without_a_movement_closes(world):
    m, contract, tables = world
    case = run_case(m, contract, "2024-02", {"region": "East"}, "2022-01", tables)
    assert case.notes == {"closed": "at verification"} and case.verdict is None
    assert run_case(m, contract, "2024-02", {"region": "East"}, "2022-01", force=True).contributions.count() > 0


def test_periods_are_replayed(spark, sf):
    out = replayed(model(spark, sf), [CONTRACTS["gross_sales"]], ["2001-06", "2001-07"], FIRST).collect()
    assert len(out) == 10 and {r.period for r in out} == {"2001-06", "2001-07"}


def test_batches_come_in_after_the_replay(spark):
    invoice = "invoice_id string, account_id string, invoice_date date, currency string, amount_gross double, amount_net double, _ingested_at timestamp_ntz"
    line = "invoice_id string, line_no long, invoice_date date, account_id string, qty long, unit_price double, amount_gross double, discount double, amount_net double, is_recurring int, _ingested_at timestamp_ntz"
    months = [date(2023, m, 28) for m in range(1, 13)]
    at = lambda d: datetime(d.year, d.month, d.day)
    heads = spark.createDataFrame([(f"I{i}-{d.month}", f"A{i}", d, "INR", 200.0, 190.0, at(d)) for d in months for i in range(3)], invoice)
    lines = spark.createDataFrame([(f"I{i}-{d.month}", n, d, f"A{i}", 2, 50.0, 100.0, 5.0, 95.0, n - 1, at(d)) for d in months for i in range(2) for n in (1, 2)], line)
    accounts = spark.createDataFrame([(f"A{i}", "East") for i in range(3)], "account_id string, region string")
    m = Model({"invoice": Fact(heads, "invoice_date", "_ingested_at"), "invoice_line": Fact(lines, "invoice_date", "_ingested_at")}, accounts)
    period, grown = next_batch(m, 7)
    new = {r.invoice_id: r for r in grown.facts["invoice"].df.where("invoice_date >= '2024-01-01'").collect()}
    assert period == "2024-01" and new.keys() == {f"I{i}-12-202401" for i in range(3)} and new["I2-12-202401"].amount_net == 0.0
    sums = {r.invoice_id: r.s for r in grown.facts["invoice_line"].df.groupBy("invoice_id").agg(F.round(F.sum("amount_net"), 2).alias("s")).collect()}
    assert all(abs(new[k].amount_net - sums[k]) < 0.005 and 150 < sums[k] < 230 for k in new if k in sums)
    contracts = [contract_of({"id": k, "formula": f"SUM({t}.amount_net)", "history_start": "2023-01-01", "materiality": {"relative": 0.1, "absolute": 1.0}}) for k, t in (("billed", "invoice"), ("lines", "invoice_line"))]
    out = replayed(m, contracts, ["2023-12"], "2023-01", batches=2, seed=7).collect()
    assert sorted((r.period, r.kpi) for r in out) == [(p, k) for p in ("2023-12", "2024-01", "2024-02") for k in ("billed", "lines")]
    assert all(r.value and r.status != "unverifiable" for r in out)
    with pytest.raises(ValueError):
        replayed(Model({"invoice": m.facts["invoice"]}, accounts), contracts[:1], [], "2023-01", batches=1)


def test_providers(tmp_path):
    with pytest.raises(CacheMiss):
        Replay(tmp_path).complete("s", "u", {})
    recorded = Replay(tmp_path, Stub({"headline": "x"})).complete("s", "u", {})[0]
    assert Replay(tmp_path).complete("s", "u", {})[0] == recorded == {"headline": "x"}
    assert Usage(1, 2_000_000, 1_000_000).cost(3.0, 15.0) == 21.0

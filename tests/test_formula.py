from datetime import date

import pytest

from tidemark.plans.contract import ContractError, contract_of, incompatible, load_contracts, load_personas, problems
from tidemark.plans.contract import Persona
from tidemark.plans.formula import FormulaError, parse


def test_terms_and_sides():
    f = parse("(SUM(a.x) + SUM(b.y * 2)) / SUM(a.z)")
    assert [(t.sign, t.aggregate, t.expression, t.table) for t in f.terms] == [(1, "SUM", "x", "a"), (1, "SUM", "y * 2", "b"), (1, "SUM", "z", "a")]
    assert f.tables == ["a", "b"] and not f.is_additive
    g = parse("SUM(a.x) - COUNT(b.y)")
    assert [t.sign for t in g.terms] == [1, -1] and g.is_additive and g.divisor == 1
    assert parse("MEDIAN(date_diff('minute', t.a, t.b)) / 60.0").divisor == 60
    assert "timestampdiff(MINUTE, date_trunc('MINUTE', a), date_trunc('MINUTE', b))" in parse("MEDIAN(date_diff('minute', t.a, t.b))").terms[0].sql


@pytest.mark.parametrize(
    "text",
    ["SUM(a.x) + SUM(a.y) / SUM(a.z)", "SUM(a.x) / SUM(a.y) / 2", "SUM(a.x + b.y)", "SUM(x)", "a.x", "MAX(a.x)", "SUM(a.x", "SUM(a.x))", "SUM(a.x) SUM(a.y)", ""],
)
def test_what_is_no_formula(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_a_table_without_periods():
    with pytest.raises(FormulaError):
        parse("SUM(a.x)", frozenset({"b"}))


RAW = {
    "id": "k",
    "formula": "SUM(a.x)",
    "history_start": "2023-04-01",
    "materiality": {"relative": 0.03, "absolute": 1.0},
    "owner_role": "cfo",
    "epochs": [{"effective_from": "2023-04-01", "formula": "SUM(a.g)"}, {"effective_from": "2025-11-01", "formula": "SUM(a.x)"}],
    "drivers": [{"id": "d", "probe": "p", "lever": {"action": "go", "owner_role": "ops"}}],
    "access": {"row": {"region": {"cfo": ["*"], "vp": ["own_region"]}}},
}
KNOWN = {"roles": frozenset({"cfo", "ops", "vp"}), "tables": frozenset({"a"}), "probes": frozenset({"p"}), "kpis": frozenset()}


def test_contracts():
    c = contract_of(RAW)
    assert problems(c, **KNOWN) == []
    assert c.formula_for(date(2024, 1, 31)) == "SUM(a.g)" and c.formula_for(date(2025, 11, 1)) == "SUM(a.x)" and c.formula_for(date(2020, 1, 1)) == "SUM(a.g)"
    assert c.previous_formula(date(2025, 11, 30)) == "SUM(a.g)" and c.previous_formula(date(2024, 1, 1)) is None
    bad = contract_of(RAW | {"owner_role": "ceo", "formula": "SUM(a.y)", "composition": ["other"], "drivers": RAW["drivers"] * 2, "lineage": ["x.raw → x.y"]})
    assert len(problems(bad, **KNOWN)) == 6
    with pytest.raises(ContractError):
        contract_of(RAW | {"colour": "red"})
    people = {p.id: p for p in (Persona("a", "cfo"), Persona("b", "vp"), Persona("c", "guest"))}
    assert incompatible(people, c) == ["b has no region of its own", "c has no grant on region"]


FILE = """
id: net
label: Net
owner_role: cfo
definition: >
  What is invoiced.
unit: INR
direction: up_is_good
grain: [date, account_id]
calendar: fiscal_445
formula: SUM(line.net) - SUM(credit.amount)
filters:
  - line.currency = 'INR'
refresh: { source: billing, cadence: daily, sla_hours: 26 }
epochs:
  - { effective_from: 2023-04-01, formula: "SUM(line.gross)" }
  - { effective_from: 2026-02-01, formula: "SUM(line.net) - SUM(credit.amount)" }
composition:
  - { kpi: renewals, weight: recurring, transform: x }
decomposition_dims: [region, account]
materiality: { relative: 0.03, absolute: 2_500_000, min_persistence: 2, z_threshold: 3.0 }
data_quality: { max_single_record_share: 0.3, min_completeness: 0.9 }
drivers:
  - id: delay
    type: internal_controllable
    evidence_sources: [tickets]
    max_lag_days: 45
    probe_sql: probes/ticket_spike.sql
    lever: { action: go, owner_role: ops, lag_days: 14, save_rate: [0.75, 1.00] }
  - id: season
    type: external_uncontrollable
    evidence_sources: [series]
    max_lag_days: 0
    lever: null
lineage:
  upstream:
    - raw.line -> a.line (dedupe)
  joins:
    - a.account ON account_id
  downstream: [metric.nrr]
access:
  row: { region: { cfo: ["*"], vp: [own_region] } }
  column: { account_name: [cfo] }
  domain: { segment: { vp: [smb] } }
  masking: { account_name: hash_alias }
history_start: 2023-04-01
seasonal_period_days: 365
"""


def test_contract_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "net.yaml").write_text(FILE)
    c = load_contracts(tmp_path)["net"]
    assert (c.source, c.cadence, c.quality.sla_hours, c.quality.min_completeness, c.dimensions, c.composition) == ("billing", "daily", 26, 0.9, ("region", "account"), ("renewals",))
    assert (c.calendar, c.unit, c.materiality.absolute, c.epochs[1].effective_from) == ("fiscal_445", "INR", 2_500_000, date(2026, 2, 1))
    assert [d.probe for d in c.drivers] == ["ticket_spike", None] and c.drivers[0].lever.save_rate == (0.75, 1.0) and c.drivers[1].lever is None
    known = {"roles": frozenset({"cfo", "ops", "vp"}), "tables": frozenset({"raw.line", "a.line", "a.account"}), "probes": frozenset({"ticket_spike"}), "kpis": frozenset({"renewals"})}
    assert problems(c, **known) == [] and len(problems(c, **known | {"tables": frozenset()})) == 3
    (tmp_path / "net.yaml").write_text(FILE + "colour: red\n")
    with pytest.raises(ContractError, match="colour"):
        load_contracts(tmp_path)
    (tmp_path / "net.yaml").write_text(FILE.replace("cadence: daily,", "cadence: daily, rhythm: odd,"))
    with pytest.raises(ContractError, match="rhythm"):
        load_contracts(tmp_path)


def test_persona_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("id: a\nrole_key: cfo\nlabel: CFO\nregion: null\n")
    (tmp_path / "b.yaml").write_text("id: b\nrole_key: vp\nlabel: VP\nregion: East\n")
    assert load_personas(tmp_path)["b"] == Persona("b", "vp", "VP", "East")
    (tmp_path / "c.yaml").write_text("id: a\nrole_key: x\n")
    with pytest.raises(ContractError, match="twice"):
        load_personas(tmp_path)

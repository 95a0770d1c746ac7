"""KPI contracts and personas: what a metric is, how it is judged, and who may see what."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from tidemark.plans.formula import Formula, FormulaError, parse

_TABLES_IN_LINEAGE = re.compile(r"\b([a-z_]+)\.([a-z_]+)\b")


class ContractError(ValueError):
    """Everything that is wrong with a contract, not the first thing only."""

    def __init__(self, source: str, problems: list[str]):
        super().__init__(f"{source}: " + "; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Materiality:
    relative: float
    absolute: float
    min_persistence: int = 2
    z_threshold: float = 3.0


@dataclass(frozen=True)
class Quality:
    max_single_record_share: float = 0.35
    min_completeness: float = 0.98
    sla_hours: float = 24.0


@dataclass(frozen=True)
class Lever:
    action: str
    owner_role: str
    save_rate: tuple[float, float] = (0.0, 1.0)
    lag_days: int = 0


@dataclass(frozen=True)
class Driver:
    id: str
    type: str = "internal_controllable"
    evidence_sources: tuple[str, ...] = ()
    max_lag_days: int = 0
    probe: str | None = None
    lever: Lever | None = None


@dataclass(frozen=True)
class Epoch:
    effective_from: date
    formula: str


@dataclass(frozen=True)
class Access:
    row: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    column: dict[str, list[str]] = field(default_factory=dict)
    domain: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    masking: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Contract:
    id: str
    formula: str
    materiality: Materiality
    label: str = ""
    owner_role: str = ""
    filters: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    epochs: tuple[Epoch, ...] = ()
    quality: Quality = Quality()
    composition: tuple[str, ...] = ()
    drivers: tuple[Driver, ...] = ()
    lineage: tuple[str, ...] = ()
    access: Access = Access()
    history_start: date = date(1970, 1, 1)
    seasonal_period_days: int = 365
    source: str = ""
    cadence: str = "daily"
    definition: str = ""
    unit: str = ""
    direction: str = "up_is_good"
    grain: tuple[str, ...] = ()
    calendar: str = ""
    lineage_of: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def parsed(self) -> Formula:
        return parse(self.formula)

    def formula_for(self, when: date) -> str:
        """The definition in force on a day: the last epoch that has begun, or the first one."""
        begun = [e for e in self.epochs if e.effective_from <= when]
        return (begun[-1] if begun else self.epochs[0]).formula if self.epochs else self.formula

    def previous_formula(self, when: date) -> str | None:
        """The latest earlier definition that differs from the one in force on a day."""
        now = self.formula_for(when)
        return next((e.formula for e in reversed(self.epochs) if e.effective_from <= when and e.formula != now), None)


@dataclass(frozen=True)
class Persona:
    id: str
    role_key: str
    label: str = ""
    region: str | None = None


def problems(contract: Contract, roles: frozenset[str], tables: frozenset[str], probes: frozenset[str], kpis: frozenset[str]) -> list[str]:
    """Unknown roles, tables, probes and composed KPIs, repeated drivers, and epochs that don't make a history."""
    found = []
    named = {contract.owner_role, *(d.lever.owner_role for d in contract.drivers if d.lever)}
    for grants in (*contract.access.row.values(), *contract.access.domain.values()):
        named |= set(grants)
    for who in contract.access.column.values():
        named |= set(who)
    found += [f"unknown role {r!r}" for r in sorted(named - roles - {""})]
    for line in contract.lineage:
        found += [f"lineage names unknown table {m[0]!r}" for m in _TABLES_IN_LINEAGE.finditer(line) if m[0] not in tables and m[2] not in tables]
    ids = [d.id for d in contract.drivers]
    found += [f"driver {i!r} is declared twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    found += [f"driver {d.id!r} has no probe {d.probe!r}" for d in contract.drivers if d.probe and d.probe not in probes and not d.probe.endswith(".sql")]
    found += [f"composition names unknown KPI {k!r}" for k in contract.composition if k not in kpis]
    starts = [e.effective_from for e in contract.epochs]
    if starts:
        if starts != sorted(set(starts)):
            found.append("epochs don't ascend")
        if starts[0] != contract.history_start:
            found.append("the first epoch doesn't begin with the history")
        if contract.epochs[-1].formula != contract.formula:
            found.append("the last epoch's formula isn't the current one")
    for text in (contract.formula, *(e.formula for e in contract.epochs)):
        try:
            parse(text)
        except FormulaError as e:
            found.append(str(e))
    return found


def _day(value: Any) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value))


def _built(kind: type, raw: dict[str, Any] | None, source: str) -> Any:
    raw = raw or {}
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(raw) - names):
        raise ContractError(source, [f"unknown key {k!r} in {kind.__name__.lower()}" for k in unknown])
    try:
        return kind(**raw)
    except TypeError as e:
        raise ContractError(source, [str(e)]) from e


def _plain(raw: dict[str, Any], source: str) -> dict[str, Any]:
    """The vocabulary of contract files in that of Contract: refresh, data_quality, decomposition_dims, probe_sql, edges and parts of lineage."""
    raw = dict(raw)
    both = [f"{a} and {b} say the same" for a, b in (("quality", "data_quality"), ("dimensions", "decomposition_dims")) if a in raw and b in raw]
    if both:
        raise ContractError(source, both)
    refresh = dict(raw.pop("refresh", {}))
    quality = dict(raw.pop("data_quality", raw.get("quality", {})))
    if "sla_hours" in refresh:
        quality["sla_hours"] = refresh.pop("sla_hours")
    raw["quality"] = quality
    if unknown := sorted(set(refresh) - {"source", "cadence"}):
        raise ContractError(source, [f"unknown key {k!r} in refresh" for k in unknown])
    raw |= refresh
    raw["dimensions"] = raw.pop("decomposition_dims", raw.get("dimensions", ()))
    raw["composition"] = [c["kpi"] if isinstance(c, dict) else c for c in raw.get("composition") or ()]
    drivers = []
    for d in raw.get("drivers") or ():
        d = dict(d)
        if d.get("probe_sql"):
            d["probe"] = Path(d["probe_sql"]).stem
        d.pop("probe_sql", None)
        drivers.append(d)
    raw["drivers"] = drivers
    if isinstance(lineage := raw.get("lineage"), dict):
        raw["lineage_of"] = {k: tuple(v) for k, v in lineage.items()}
        raw["lineage"] = [line for k in ("upstream", "joins") for line in lineage.get(k, ())]
    return raw


def contract_of(raw: dict[str, Any], source: str = "contract") -> Contract:
    """A contract from plain values, as they stand in a contract file or named as Contract's fields are; unknown keys are errors."""
    raw = _plain(raw, source)
    raw["materiality"] = _built(Materiality, raw.get("materiality"), source)
    raw["quality"] = _built(Quality, raw.get("quality"), source)
    raw["access"] = _built(Access, raw.get("access"), source)
    raw["epochs"] = tuple(_built(Epoch, e | {"effective_from": _day(e["effective_from"])}, source) for e in raw.get("epochs", ()))
    drivers = []
    for d in raw.get("drivers", ()):
        lever = d.get("lever")
        lever = lever and _built(Lever, lever | {"save_rate": tuple(lever.get("save_rate", (0.0, 1.0)))}, source)
        drivers.append(_built(Driver, d | {"lever": lever, "evidence_sources": tuple(d.get("evidence_sources", ()))}, source))
    raw["drivers"] = tuple(drivers)
    for name in ("filters", "dimensions", "composition", "lineage", "grain"):
        raw[name] = tuple(raw.get(name, ()))
    if "history_start" in raw:
        raw["history_start"] = _day(raw["history_start"])
    return _built(Contract, raw, source)


def _yaml(path: Path) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:  # YAML is a convenience; contract_of() takes plain values
        raise RuntimeError("reading YAML files needs the yaml package") from e
    return yaml.safe_load(path.read_text(encoding="utf-8"))


def load_contract(path: Path | str) -> Contract:
    return contract_of(_yaml(Path(path)), str(path))


def load_contracts(folder: Path | str) -> dict[str, Contract]:
    """By id, in order of file names."""
    return {c.id: c for c in (load_contract(p) for p in sorted(Path(folder).glob("*.yaml")))}


def load_personas(folder: Path | str) -> dict[str, Persona]:
    out: dict[str, Persona] = {}
    for path in sorted(Path(folder).glob("*.yaml")):
        persona = _built(Persona, _yaml(path), str(path))
        if persona.id in out:
            raise ContractError(str(path), [f"persona {persona.id!r} is declared twice"])
        out[persona.id] = persona
    return out


def incompatible(personas: dict[str, Persona], contract: Contract) -> list[str]:
    """Personas whose rules in the contract can't be resolved: a role without grants, or 'own_region' without a region."""
    out = []
    for p in personas.values():
        for dimension, grants in contract.access.row.items():
            if p.role_key not in grants:
                out.append(f"{p.id} has no grant on {dimension}")
            elif "own_region" in grants[p.role_key] and not p.region:
                out.append(f"{p.id} has no region of its own")
    return out

"""All that the checks of many contracts ask of a table, in one grouping of it: the sweep's only pass over the records."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.contract import Contract
from tidemark.plans.formula import Formula, Term, parse
from tidemark.plans.panel import Model, Terms, _filters, _to_be_joined, bounds, in_force, labelled, scoped, valued

#: Days after a period in which its records may still come in, beyond the agreed hours.
GRACE_DAYS, LATE_DAYS = 1, 2
KNOWN = "_known"


def definitions(contract: Contract) -> list[Formula]:
    """The formulas that a contract has or had."""
    return [parse(t) for t in dict.fromkeys([contract.formula, *(e.formula for e in contract.epochs)])]


@dataclass(frozen=True)
class Base:
    """Rows of a table that are read together: what can't be asked row by row, subqueries, filters all of them."""

    table: str
    subqueries: tuple[str, ...] = ()
    medians: bool = False  # apart, as they keep all values and would slow down the sums beside them


class Gathered:
    """rows: period, the dimensions, whether the account is known, and a column for each thing that is asked of a base."""

    def __init__(self, model: Model, contracts: list[Contract], dims: list[str], first: str | None = None, last: str | None = None):
        self.model, self.dims = model, dims
        self.months = (first, last) if first and last else ()
        self.columns: dict[Base, dict[tuple, tuple[str, Column, str]]] = {}  # (name, aggregate, how it merges)
        self.filters = {c.id: _filters(model, c, definitions(c)) for c in contracts}
        for c in contracts:
            for t in dict.fromkeys(t for f in definitions(c) for t in f.terms):
                self._term(c, t)
            for name, _ in self.measured(c):
                self._late(c, name)
        parts = [self._grouped(b) for b in self.columns]
        self.rows = parts[0]
        if len(parts) > 1:
            for p in parts[1:]:
                self.rows = self.rows.unionByName(p, allowMissingColumns=True)
            names = [n for asked in self.columns.values() for n, *_ in asked.values()]
            self.rows = self.rows.groupBy("period", *dims, KNOWN).agg(*(F.max(n).alias(n) for n in names))

    def _where(self, contract: Contract, table: str) -> tuple[Base, str]:
        texts = self.filters[contract.id].get(table, [])
        hard = tuple(t for t in texts if "select" in t.lower())
        return Base(table, hard), " AND ".join(f"({t})" for t in texts if t not in hard)

    def _ask(self, base: Base, key: tuple, value: Column, merge: str) -> str:
        asked = self.columns.setdefault(base, {})
        if key not in asked:
            asked[key] = (f"c{sum(map(len, self.columns.values()))}", value, merge)
        return asked[key][0]

    def _term(self, contract: Contract, term: Term) -> dict[str, str]:
        """Names of the columns of a term: there, how many rows count; its value's parts; the largest and the late ones."""
        base, condition = self._where(contract, term.table)
        when = F.expr(condition) if condition else F.lit(True)
        only = f" FILTER (WHERE {condition})" if condition else ""
        inner = F.expr(term.inner).cast("double")
        size = F.abs(F.lit(1.0) if term.aggregate == "COUNT" else inner)
        out = {"there": self._ask(base, ("there", condition), F.count_if(when), "sum")}
        if term.aggregate == "AVG":
            out |= {"sum": self._ask(base, ("sum", term.inner, condition), F.sum(F.when(when, inner)), "sum"), "n": self._ask(base, ("n", term.inner, condition), F.count(F.when(when, inner)), "sum")}
        else:
            of = replace(base, medians=True) if term.aggregate == "MEDIAN" else base
            out["value"] = self._ask(of, (term.sql, condition), F.expr(term.sql + only).cast("double"), "none" if term.aggregate == "MEDIAN" else "sum")
        out["largest"] = self._ask(base, ("largest", term.aggregate == "COUNT", term.inner, condition), F.max(F.when(when, size)), "max")
        came = self.model.facts[term.table].ingested
        if came:
            start, end = F.col("period"), F.last_day("period")
            late = when & ((F.to_date(came) < start) | (F.to_date(came) > F.date_add(end, LATE_DAYS)))
            out["slipped"] = self._ask(base, ("slipped", term.aggregate == "COUNT", term.inner, condition), F.sum(F.when(late, size)), "sum")
        return out

    def measured(self, contract: Contract) -> list[tuple[str, str]]:
        """The numerator's tables that say when rows came in, and where they say it."""
        tables = dict.fromkeys(t.table for t in contract.parsed.numerator)
        return [(t, self.model.facts[t].ingested) for t in tables if self.model.facts[t].ingested]

    def _late(self, contract: Contract, table: str) -> tuple[str, str]:
        came = F.col(self.model.facts[table].ingested).cast("timestamp_ntz")
        seconds = int((GRACE_DAYS * 24 + contract.quality.sla_hours) * 3600)
        end = F.last_day("period").cast("timestamp_ntz") + F.expr(f"INTERVAL {seconds} SECOND")
        return self._ask(Base(table), ("rows",), F.count(F.lit(1)), "sum"), self._ask(Base(table), ("on time", seconds), F.count_if(came <= end), "sum")

    def _grouped(self, base: Base) -> DataFrame:
        asked, keys = [*self.columns[base].values()], ["period", *self.dims, KNOWN]
        first = [value.alias(name) for name, value, _ in asked]
        missing = _to_be_joined(self.model, base.table, self.dims)
        if missing and all(merge != "none" for *_, merge in asked):
            # the join to accounts will shuffle: a row an account and month first
            direct = [d for d in self.dims if d not in missing]
            small = scoped(self.model, base.table, [*base.subqueries], direct, months=self.months).groupBy("period", "account_id", *direct).agg(*first)
            of = self.model.accounts.select("account_id", *missing).withColumn(KNOWN, F.lit(True))
            wide = small.join(of, "account_id", "left").withColumn(KNOWN, F.coalesce(KNOWN, F.lit(False)))
            return labelled(wide.groupBy(*keys).agg(*((F.max if merge == "max" else F.sum)(name).alias(name) for name, _, merge in asked)))
        return labelled(scoped(self.model, base.table, [*base.subqueries], self.dims, months=self.months, known=KNOWN).groupBy(*keys).agg(*first))

    def _some(self, contract: Contract, formulas: list[Formula]) -> Column:
        """Whether a table of the formulas has a row that counts, in a slice and period."""
        some = F.lit(False)
        for c in sorted({self._term(contract, t)["there"] for f in formulas for t in f.terms}):
            some = some | (F.coalesce(c, F.lit(0)) > 0)
        return some

    def _there(self, contract: Contract, formulas: list[Formula]) -> DataFrame:
        return self.rows.where(F.col(KNOWN) & self._some(contract, formulas))

    def _value(self, contract: Contract, term: Term) -> Column:
        c = self._term(contract, term)
        return F.col(c["value"]) if "value" in c else F.try_divide(F.col(c["sum"]), F.nullif(F.col(c["n"]).cast("double"), F.lit(0.0)))

    def _records(self, contract: Contract) -> tuple[Column, Column]:
        columns = [self._term(contract, t) for t in contract.parsed.terms]
        largest = [F.col(c["largest"]) for c in columns]
        slipped = sum((F.coalesce(c["slipped"], F.lit(0.0)) for c in columns if "slipped" in c), F.lit(0.0))
        return F.greatest(*largest) if len(largest) > 1 else largest[0], slipped

    def panels(self, contracts: list[Contract]) -> DataFrame:
        """kpi, period, the slice, value under the definition in force, largest and slipped (null unless additive) of all contracts, in one pass over the rows."""
        each = []
        for c in contracts:
            formulas = {f.text: f for f in definitions(c)}
            epochs = sorted(c.epochs, key=lambda e: e.effective_from)
            values = {t: valued(f, {x.key: self._value(c, x) for x in f.terms}) for t, f in formulas.items()}
            value = in_force(epochs, epochs[0].formula if epochs else c.formula, values, bounds(F.col("period"))[1])[2]
            used = [formulas[t] for t in dict.fromkeys(e.formula for e in epochs)] or [formulas[c.formula]]
            largest, slipped = self._records(c) if c.parsed.is_additive else (F.lit(None), F.lit(None))
            each.append(F.struct(F.lit(c.id).alias("kpi"), self._some(c, used).alias("_some"), value.alias("value"), largest.cast("double").alias("largest"), slipped.cast("double").alias("slipped")))
        return self.rows.where(KNOWN).select("period", *self.dims, F.inline(F.array(*each))).where("_some").drop("_some")

    def completenesses(self, contracts: list[Contract]) -> DataFrame | None:
        """kpi, period, complete_share and complete of the contracts that are measured, in one pass over the rows; None without any."""
        pairs = {c.id: [self._late(c, t) for t, _ in self.measured(c)] for c in contracts}
        columns = sorted({n for of in pairs.values() for p in of for n in p})
        if not columns:
            return None
        sums = self.rows.groupBy("period").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in columns))
        added = lambda c, i: sum((F.col(p[i]) for p in pairs[c.id]), F.lit(0))
        each = [F.struct(F.lit(c.id).alias("kpi"), F.try_divide(added(c, 1).cast("double"), F.nullif(added(c, 0).cast("double"), F.lit(0.0))).alias("complete_share"), F.lit(c.quality.min_completeness).alias("_least")) for c in contracts if pairs[c.id]]
        out = sums.select("period", F.inline(F.array(*each))).where("complete_share IS NOT NULL")
        return out.withColumn("complete", F.col("complete_share") >= F.col("_least")).drop("_least")

    def terms(self, contract: Contract, formulas: list[Formula] | None = None) -> Terms:
        """As term_panel(), of all formulas of a contract or of those that are given."""
        formulas = formulas or definitions(contract)
        names, out = {}, {}
        for i, t in enumerate(dict.fromkeys(t for f in formulas for t in f.terms)):
            if t.key not in names:
                names[t.key] = f"t{i}"
                out[f"t{i}"] = self._value(contract, t)
        return self._there(contract, formulas).select("period", *self.dims, *(v.alias(n) for n, v in out.items())), names

    def records(self, contract: Contract) -> DataFrame:
        """period, the slice, largest and slipped, for contracts that add up over their records."""
        if not contract.parsed.is_additive:
            raise ValueError(f"{contract.id} doesn't add up over its records")
        largest, slipped = self._records(contract)
        return self._there(contract, [contract.parsed]).select("period", *self.dims, largest.alias("largest"), slipped.alias("slipped"))

    def completeness(self, contract: Contract) -> DataFrame | None:
        """period, n_rows, on_time, share, complete; None if no table says when its rows came in. Neither filters nor slices apply."""
        pairs = [self._late(contract, t) for t, _ in self.measured(contract)]
        if not pairs:
            return None
        added = [sum((F.coalesce(F.sum(p[i]), F.lit(0)) for p in pairs), F.lit(0)).cast("long") for i in (0, 1)]
        out = self.rows.groupBy("period").agg(added[0].alias("n_rows"), added[1].alias("on_time")).where("n_rows > 0")
        share = F.col("on_time") / F.col("n_rows")
        return out.withColumn("share", share).withColumn("complete", F.col("share") >= contract.quality.min_completeness)


def gathered(model: Model, contracts: list[Contract], dims: list[str], first: str | None = None, last: str | None = None) -> Gathered:
    """What is asked of the tables by all contracts."""
    return Gathered(model, contracts, dims, first, last)

"""KPI panels: a contract's formula over all periods and slices at once, as one grouped plan for each table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_sum
from tidemark.plans.contract import Contract
from tidemark.plans.formula import Formula, FormulaError, Term, parse

_NAMED = re.compile(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\b")


@dataclass(frozen=True)
class Fact:
    """A table with the column that places its rows in a period and the one that says when they came in."""

    df: DataFrame
    period: str
    ingested: str | None = None


@dataclass(frozen=True)
class Model:
    """Facts by name; accounts, which facts refer to by account_id, carry the dimensions that facts lack."""

    facts: dict[str, Fact]
    accounts: DataFrame | None = None
    calendar: DataFrame | None = None  # day, period_label: fiscal periods
    views: dict[str, DataFrame] = field(default_factory=dict)  # what filters may name in subqueries

    def has(self, table: str, dimension: str) -> bool:
        return dimension in self.facts[table].df.columns or (self.accounts is not None and dimension in self.accounts.columns and "account_id" in self.facts[table].df.columns)


def sliceable(model: Model, formula: Formula, dimension: str) -> bool:
    """Every term's table has the dimension, itself or by its account."""
    return all(model.has(t, dimension) for t in formula.tables)


def _filters(model: Model, contract: Contract, formulas: list[Formula]) -> dict[str, list[str]]:
    """Each filter goes to the tables of the formulas that it names; one that names no table of the contract would filter nothing, and is an error."""
    tables = {t for f in formulas for t in f.tables}
    known = tables | set(contract.parsed.tables)
    out: dict[str, list[str]] = {t: [] for t in tables}
    for text in contract.filters:
        named = {m[1] for m in _NAMED.finditer(text)}
        if not named & known:
            raise FormulaError(f"filter {text!r} of {contract.id} names no table of its formula, which reads {', '.join(sorted(known))}")
        for t in sorted(named & tables):
            out[t].append(_NAMED.sub(lambda m, t=t: m[2] if m[1] == t else m[0], text))
    return out


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of right where all of `on` are the same; a null is the same as a null."""
    keys = [F.col(c).alias(f"_same_{i}") for i, c in enumerate(on)]
    other = right.select(*keys, *(c for c in right.columns if c not in on))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_same_{i}"))
    return left.join(other, same, how).drop(*(f"_same_{i}" for i in range(len(on))))


def bounds(period: Column) -> tuple[Column, Column]:
    """The first and the last day of a month given as yyyy-MM."""
    start = F.to_date(F.concat(period, F.lit("-01")))
    return start, F.last_day(start)


def scoped(model: Model, table: str, filters: list[str], dims: list[str], fiscal: bool = False, months: tuple[str, ...] = (), known: str | None = None) -> DataFrame:
    """The rows of a fact that a contract counts, with period and the dimensions; the join to accounts only if needed.

    period is the fiscal label, or the first day of the month: labelled() names it once rows are grouped. Only days from
    the first to the last of the months are read, if any are given. Rows whose account is unknown drop out if that is
    asked for a dimension; with known they stay, and a column of that name tells them apart.
    """
    fact = model.facts[table]
    for name, view in model.views.items():
        view.createOrReplaceTempView(name)
    df, day = fact.df, F.to_date(fact.period)
    if months and not fiscal:
        start, end = (bounds(F.lit(m))[i] for i, m in enumerate((min(months), max(months))))
        df = df.where(day.between(start, end))
    period = F.trunc(day, "MM")
    if fiscal:
        calendar = model.calendar.select(F.col("day").alias("_day"), F.col("period_label").alias("_label"))
        df, period = df.join(calendar, day == F.col("_day")), F.col("_label")
    for text in filters:
        df = df.where(text)
    missing = [d for d in dims if d not in fact.df.columns]
    if missing:
        if model.accounts is None or not set(missing) <= set(model.accounts.columns) or "account_id" not in df.columns:
            raise FormulaError(f"{table} can't be sliced by {', '.join(missing)}")
        of = model.accounts.select("account_id", *missing)
        df = df.join(of.withColumn(known, F.lit(True)), "account_id", "left").withColumn(known, F.coalesce(known, F.lit(False))) if known else df.join(of, "account_id")
    elif known:
        df = df.withColumn(known, F.lit(True))
    return df.withColumn("period", period)


def labelled(df: DataFrame, fiscal: bool = False) -> DataFrame:
    """Periods as yyyy-MM; fiscal ones have their label already."""
    return df if fiscal else df.withColumn("period", F.date_format("period", "yyyy-MM"))


def _larger_than_broadcast(df: DataFrame) -> bool:
    """Whether what a plan reads is more than Spark broadcasts by itself."""
    limit = df.sparkSession._jvm.org.apache.spark.sql.internal.SQLConf.get().autoBroadcastJoinThreshold()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) > max(limit, 0)


def _to_be_joined(model: Model, table: str, dims: list[str]) -> list[str]:
    """The dimensions for which the join to accounts will shuffle."""
    missing = [d for d in dims if d not in model.facts[table].df.columns]
    there = model.accounts is not None and set(missing) <= set(model.accounts.columns)
    return missing if missing and there and _larger_than_broadcast(model.accounts) else []


def _aggregate(term: Term, df: DataFrame, exact: bool) -> Column:
    if exact and term.aggregate == "SUM" and df.select(F.expr(term.inner)).dtypes[0][1] in ("double", "float"):
        return exact_sum(F.expr(term.inner))
    return F.expr(term.sql).cast("double")


def _table_terms(model: Model, table: str, terms: list[tuple[int, Term]], filters: list[str], dims: list[str], fiscal: bool, months: tuple[str, ...], exact: bool) -> DataFrame:
    aggregates = [_aggregate(t, model.facts[table].df, exact).alias(f"t{i}") for i, t in terms]
    total = exact_sum if exact else F.sum
    keys = ["period", *dims]
    missing = _to_be_joined(model, table, dims)
    if missing and all(t.aggregate in ("SUM", "COUNT") for _, t in terms):
        # the join to accounts will shuffle: add up per account first, so that it moves a row a key and not a row a record
        direct = [d for d in dims if d not in missing]
        small = scoped(model, table, filters, direct, fiscal, months).groupBy("period", "account_id", *direct).agg(*aggregates)
        with_dims = small.join(model.accounts.select("account_id", *missing), "account_id")
        return labelled(with_dims.groupBy(*keys).agg(*(total(F.col(f"t{i}")).alias(f"t{i}") for i, _ in terms)), fiscal)
    return labelled(scoped(model, table, filters, dims, fiscal, months).groupBy(*keys).agg(*aggregates), fiscal)


def term_panel(model: Model, contract: Contract, formulas: list[Formula], dims: list[str], fiscal: bool = False, months: tuple[str, ...] = (), exact: bool = False) -> tuple[DataFrame, dict[tuple, str]]:
    """period, the dimensions and a column for each distinct term of all the formulas; null where a table has no row.

    Each table is read and grouped once, whatever the number of its terms and formulas, and only from the first to the last
    of the months, if any are given. Tables meet in a union and one more grouping, which, unlike a full join, also
    matches null dimensions. With exact, sums don't hang on the order of rows.
    """
    distinct = list({t.key: t for f in formulas for t in f.terms}.values())
    filters = _filters(model, contract, formulas)
    by_table: dict[str, list[tuple[int, Term]]] = {}
    for i, t in enumerate(distinct):
        by_table.setdefault(t.table, []).append((i, t))
    parts = [_table_terms(model, table, terms, filters[table], dims, fiscal, months, exact) for table, terms in by_table.items()]
    panel = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            panel = panel.unionByName(p, allowMissingColumns=True)
        panel = panel.groupBy("period", *dims).agg(*(F.max(f"t{i}").alias(f"t{i}") for i in range(len(distinct))))
    return panel, {t.key: f"t{i}" for i, t in enumerate(distinct)}


def _side(terms: tuple[Term, ...], names: dict[tuple, str | Column]) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + F.lit(float(t.sign)) * F.coalesce(names[t.key], F.lit(0.0))
    return total


def valued(formula: Formula, names: dict[tuple, str | Column]) -> tuple[Column, Column, Column]:
    """num, den and value: an empty sum is 0, a ratio over 0 is null."""
    num = _side(formula.numerator, names)
    if not formula.denominator:
        return num, F.lit(None).cast("double"), num / F.lit(formula.divisor)
    den = _side(formula.denominator, names)
    return num, den, F.try_divide(num, F.nullif(den, F.lit(0.0))) / F.lit(formula.divisor)


Terms = tuple[DataFrame, dict[tuple, str]]


def kpi_panel(model: Model, contract: Contract, dims: list[str] | None = None, formula: str | None = None, fiscal: bool = False, terms: Terms | None = None) -> DataFrame:
    """period, the dimensions, num, den, value. Each period follows the definition in force at its end, unless one is given.

    All definitions are computed in one pass over each table, or from terms, if these are there already.
    """
    dims = dims or []
    epochs = [] if formula or not contract.epochs else sorted(contract.epochs, key=lambda e: e.effective_from)
    texts = list(dict.fromkeys(e.formula for e in epochs)) or [formula or contract.formula]
    formulas = {t: parse(t, frozenset(model.facts)) for t in texts}
    panel, names = terms or term_panel(model, contract, list(formulas.values()), dims, fiscal)
    columns = {t: valued(f, names) for t, f in formulas.items()}
    end = bounds(F.col("period"))[1]
    if epochs and fiscal:
        ends = model.calendar.groupBy(F.col("period_label").alias("period")).agg(F.max("day").alias("_end"))
        panel, end = panel.join(ends, "period"), F.col("_end")
    num, den, value = in_force(epochs, texts[0], columns, end)
    return panel.select("period", *dims, num.alias("num"), den.alias("den"), value.alias("value"))


def in_force(epochs: list, first: str, columns: dict[str, tuple[Column, Column, Column]], end: Column) -> list[Column]:
    """num, den and value under the definition in force at a period's end: columns by formula, the first one's before any epoch."""
    chosen = list(columns[first])
    for e in epochs[1:]:
        chosen = [F.when(end >= F.lit(e.effective_from), now).otherwise(before) for now, before in zip(columns[e.formula], chosen, strict=True)]
    return chosen


def months(spark, first: str, last: str) -> DataFrame:
    """period: every month from first to last, both as yyyy-MM."""
    span = F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(span).alias("day")).select(F.date_format("day", "yyyy-MM").alias("period"))


def with_spine(panel: DataFrame, dims: list[str], first: str, last: str, empty: float | None) -> DataFrame:
    """Adds the months without a row to each slice: value is then `empty`, 0 for sums and null for ratios.

    Slices are the distinct ones of the panel, so the spine has as many rows as a full panel.
    """
    spine = panel.select(*dims).distinct().withColumn("period", F.explode(F.array(*(F.lit(m) for m in _months_between(first, last))))) if dims else months(panel.sparkSession, first, last)
    joined = spine.alias("s").join(panel.alias("p"), [F.col("s.period") == F.col("p.period"), *(F.col(f"s.{d}").eqNullSafe(F.col(f"p.{d}")) for d in dims)], "left")
    value = F.col("p.value") if empty is None else F.coalesce("p.value", F.lit(empty))
    return joined.select("s.period", *(f"s.{d}" for d in dims), value.alias("value"))


def _months_between(first: str, last: str) -> list[str]:
    a, b = (int(x[:4]) * 12 + int(x[5:]) - 1 for x in (first, last))
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(a, b + 1)]

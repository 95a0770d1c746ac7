"""Whether a movement is real: freshness, completeness, definition drift, artefacts and materiality, for all slices at once."""

from __future__ import annotations

import functools
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.kept import KeptPanel
from tidemark.operators.series import decomposed, material, movement, of_month_before, peer_expectation, persistence, robust_z, since_gap
from tidemark.plans.contract import Contract
from tidemark.plans.formula import parse
from tidemark.plans.gathered import gathered
from tidemark.plans.panel import Model, Terms, _months_between, joined, kpi_panel, term_panel, valued
from tidemark.sources.scratch import settled

HISTORY = 36


def freshness(marks: DataFrame, sla_hours: float | Column, as_of: datetime | None = None, *more: str) -> DataFrame:
    """source, hours, fresh: the time since each watermark. A stale source lowers confidence; it closes no case."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.col("as_of")
    hours = F.timestamp_diff("SECOND", F.col("watermark"), now) / F.lit(3600.0)
    return marks.select("source", *more, hours.alias("hours"), (hours <= sla_hours).alias("fresh"))


def completeness(model: Model, contract: Contract) -> DataFrame:
    """period, n_rows, on_time, share, complete: rows of the numerator's tables that came in by the period's end, a day and the agreed hours.

    As the definition has it, neither filters nor slices apply. A table without an ingest column isn't measured.
    """
    out = gathered(model, [contract], []).completeness(contract)
    if out is None:
        raise ValueError(f"no table of {contract.id} says when its rows came in")
    return out


def drift(model: Model, contract: Contract, dims: list[str], terms: Terms | None = None) -> DataFrame:
    """Movements over a change of definition, both periods under the earlier one: earlier_relative and drifted.

    One row for each slice and each period that has an epoch's beginning in it and whose definition differs.
    Terms of all definitions are added up in one pass.
    """
    epochs = sorted(contract.epochs, key=lambda e: e.effective_from)
    formulas = {e.formula: parse(e.formula, frozenset(model.facts)) for e in epochs}
    if len(formulas) < 2:
        return kpi_panel(model, contract, dims).where("false").select("period", *dims, F.lit(None).cast("double").alias("earlier_relative"), F.lit(None).cast("boolean").alias("drifted"))
    terms, names = terms or term_panel(model, contract, list(formulas.values()), dims)
    now, out = terms, F.lit(None).cast("double")
    for i, e in enumerate(epochs[1:], 1):
        earlier = next((x.formula for x in reversed(epochs[:i]) if x.formula != e.formula), None)
        if earlier is None:
            continue
        value = valued(formulas[earlier], names)[2]
        now = now.withColumn(f"v{i}", value).withColumn(f"v{i}_before", of_month_before(f"v{i}", dims))
        here = F.col("period") == e.effective_from.strftime("%Y-%m")
        out = F.when(here, F.try_divide(F.col(f"v{i}") - F.col(f"v{i}_before"), F.nullif(F.col(f"v{i}_before"), F.lit(0.0)))).otherwise(out)
    found = now.withColumn("earlier_relative", out).where("earlier_relative IS NOT NULL")
    return found.select("period", *dims, "earlier_relative", (F.abs("earlier_relative") < contract.materiality.relative).alias("drifted"))


def records(model: Model, contract: Contract, dims: list[str]) -> DataFrame:
    """period, the slice, largest and slipped, for additive contracts.

    largest is the largest record of the period in size, over all terms; slipped adds up, over the terms of tables
    that say when rows came in, those that came before the period or over 2 days after its end.
    """
    return gathered(model, [contract], dims).records(contract)


def artefacts(moves: DataFrame, of: DataFrame, dims: list[str], limit: float | Column) -> DataFrame:
    """Adds record_share, slipped_share and artefact to movements: the worse of the two shares is over the limit.

    The largest record counts over the period and the one before. No movement is no artefact.
    """
    two = of.withColumn("largest", F.greatest("largest", F.coalesce(of_month_before("largest", dims), F.lit(0.0))))
    out = joined(moves, two.select("period", *dims, "largest", "slipped"), ["period", *dims])
    size = F.nullif(F.abs("delta"), F.lit(0.0))
    out = out.withColumn("record_share", F.try_divide("largest", size)).withColumn("slipped_share", F.try_divide("slipped", size))
    worst = F.greatest(F.coalesce("record_share", F.lit(0.0)), F.coalesce("slipped_share", F.lit(0.0)))
    return out.withColumn("artefact", worst > limit).drop("largest", "slipped")


def _rules(spark, contracts: list[Contract], n_dims: int, period: str) -> DataFrame:
    """What the checks need to know of each contract, a row each."""
    rows = []
    for c in contracts:
        m, q = c.materiality, c.quality
        borrowed = n_dims == 1 and sparse(c, period)
        rows.append((c.id, m.relative, m.absolute, m.min_persistence, m.z_threshold, q.max_single_record_share, q.sla_hours, c.source, None if c.parsed.denominator else 0.0, borrowed))
    return spark.createDataFrame(rows, "kpi string, _relative double, _absolute double, _persistence int, _z_threshold double, _share double, _sla double, _source string, _empty double, _borrowed boolean")


def sparse(contract: Contract, period: str) -> bool:
    """Whether the history up to the period's end is shorter than two seasons, in days."""
    year, month = int(period[:4]), int(period[5:])
    end = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return (end - contract.history_start).days < 2 * contract.seasonal_period_days


def _back(period: str, months: int) -> str:
    n = int(period[:4]) * 12 + int(period[5:]) - 1 - months
    return f"{n // 12:04d}-{n % 12 + 1:02d}"


def materiality(panel: DataFrame, dims: list[str], contract: Contract, period: str) -> DataFrame:
    """The slices' movements in a period with last_z, run, material and reasons, by each slice's own history."""
    m = contract.materiality
    rules = [F.lit(x).alias(n) for n, x in (("_relative", m.relative), ("_absolute", m.absolute), ("_persistence", m.min_persistence), ("_z_threshold", m.z_threshold))]
    return _material(panel.select("*", *rules), dims, period).drop("_relative", "_absolute", "_persistence", "_z_threshold")


def _material(panel: DataFrame, dims: list[str], period: str) -> DataFrame:
    panel = panel.where(F.col("period") <= period)
    scored = robust_z(decomposed(since_gap(panel, dims, HISTORY), dims), dims, "remainder")
    runs = persistence(scored.where(F.col("remainder").isNotNull()), dims, F.col("_z_threshold"))
    moves = movement(panel, dims).where(F.col("period") == period)
    return material(joined(moves, runs, dims))


def verify(model: Model, contract: Contract, dims: list[str], period: str, first: str, marks: DataFrame | None = None, as_of: datetime | None = None) -> DataFrame:
    """One row a slice: the movement, each check and whether all passed; unverifiable slices say so."""
    return verify_all(model, [contract], dims, period, first, marks, as_of).drop("kpi")


def verify_all(model: Model, contracts: list[Contract], dims: list[str], period: str, first: str, marks: DataFrame | None = None, as_of: datetime | None = None, kept: KeptPanel | None = None) -> DataFrame:
    """verify() of several contracts: kpi and a row a slice each, in one plan.

    Each table is read once, in one grouping for all contracts, and no more than the history that the checks look at;
    the rest is plans over a row a slice and month. ceiling is 'likely' where the data are stale or the baseline is
    borrowed from peers, which happens to slices with under two seasons of history, if there is one dimension to find peers in.
    With a kept panel of these contracts and dimensions, its rows are merged instead of the tables' read.
    """
    spark = next(iter(model.facts.values())).df.sparkSession
    first = max(first, _back(period, HISTORY))
    found = kept.gathered(model, first, period) if kept else gathered(model, contracts, dims, first, period)
    found.rows = settled(found.rows)  # several plans read it
    rules, slices = F.broadcast(_rules(spark, contracts, len(dims), period)), ["kpi", *dims]  # a row a contract
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    named = lambda df, c: df.withColumn("kpi", F.lit(c.id))
    values = found.panels(contracts)
    months = F.explode(F.array(*(F.lit(m) for m in _months_between(first, period))))
    panel = joined(values.select(*slices).distinct().withColumn("period", months), values, [*slices, "period"])  # as many rows as a full panel
    panel = settled(panel.join(rules, "kpi").withColumn("value", F.coalesce("value", "_empty")))
    out = _material(panel, slices, period)
    if any(len(dims) == 1 and sparse(c, period) for c in contracts):
        peers = peer_expectation(movement(panel.where("_borrowed"), slices), dims[0], period, by=["kpi"])
        out = joined(out, peers.select(*slices, "expected", "surprise", F.col("material").alias("_of_peers")), slices)
        out = out.withColumn("material", F.when(F.col("_borrowed"), F.coalesce("_of_peers", F.lit(False))).otherwise(F.col("material"))).drop("_of_peers")
    else:
        out = out.withColumn("expected", F.lit(None).cast("double")).withColumn("surprise", F.lit(None).cast("double"))
    out = artefacts(out.drop("largest", "slipped"), panel.where("largest IS NOT NULL"), slices, F.col("_share"))
    redefined = [c for c in contracts if len({e.formula for e in c.epochs}) > 1]
    if redefined:
        out = joined(out, union([named(drift(model, c, dims, found.terms(c)), c) for c in redefined]), ["period", *slices])
    else:
        out = out.withColumn("earlier_relative", F.lit(None).cast("double")).withColumn("drifted", F.lit(False))
    out = out.withColumn("drifted", F.coalesce("drifted", F.lit(False)))
    full = found.completenesses(contracts)
    if full is None:
        out = out.withColumn("complete_share", F.lit(None).cast("double")).withColumn("complete", F.lit(True))
    else:
        unmeasured = [c.id for c in contracts if not found.measured(c)]
        out = out.join(full, ["period", "kpi"], "left").withColumn("complete", F.coalesce("complete", F.col("kpi").isin(unmeasured) if unmeasured else F.lit(False)))
    out = out.withColumn("passed", (F.col("status") == "ok") & F.col("complete") & ~F.col("drifted") & ~F.col("artefact") & F.col("material"))
    stale = F.lit(False)
    if marks is not None:
        each = marks.join(rules.select("kpi", "_sla", "_source"), (F.col("_source") == "") | (F.col("source") == F.col("_source")))  # sources by contracts
        fresh = freshness(each, F.col("_sla"), as_of, "kpi").groupBy("kpi").agg(F.bool_and("fresh").alias("fresh"))
        out = out.join(F.broadcast(fresh), "kpi", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        stale = ~F.col("fresh")
    return out.withColumn("ceiling", F.when(stale | F.col("_borrowed"), "likely")).drop(*(c for c in out.columns if c.startswith("_")))

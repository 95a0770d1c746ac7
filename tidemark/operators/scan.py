"""The sweep: every contract over every region of the latest closed period, in one pass over the records; and the scan, which investigates what it opens."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.kept import KeptPanel
from tidemark.operators.store import CaseStore
from tidemark.operators.swept import Tables, investigated
from tidemark.operators.verify import verify_all
from tidemark.plans.contract import Contract
from tidemark.plans.panel import Model, joined
from tidemark.sources.scratch import settled


class ScanError(ValueError):
    """A scan that can't know its period."""


def closed_period(watermark: Column) -> Column:
    """The month of a watermark if that has reached its end, else the one before, as yyyy-MM."""
    day = F.to_date(watermark)
    return F.date_format(F.when(day >= F.last_day(day), day).otherwise(F.add_months(day, -1)), "yyyy-MM")


def closed_periods(marks: DataFrame, contracts: list[Contract]) -> dict[str, str]:
    """The latest closed period of each contract's source, by contract. A source without a watermark is an error. Reads a row a source."""
    found = {r.source: r.period for r in marks.groupBy("source").agg(closed_period(F.max("watermark")).alias("period")).collect()}
    for c in contracts:
        if not found.get(c.source):
            raise ScanError(f"{c.id} names source {c.source!r}, which has no watermark")
    return {c.id: found[c.source] for c in contracts}


def regions(accounts: DataFrame) -> DataFrame:
    """Regions of accounts that aren't for tests, in order."""
    real = accounts.where(~F.col("is_test")) if "is_test" in accounts.columns else accounts
    return real.where(F.col("region").isNotNull()).select("region").distinct().orderBy("region")


def sweep(model: Model, contracts: list[Contract], period: str, first: str, dims: list[str] | None = None, marks: DataFrame | None = None, as_of: datetime | None = None, store: CaseStore | None = None, kept: KeptPanel | None = None) -> DataFrame:
    """case_id, kpi, period, the slice, value, delta, status (open, closed_at_verify, unverifiable) and the checks: all slices of all contracts in one plan.

    By regions, the slices are those of accounts that aren't for tests, whether or not they have a row: one without is
    unverifiable. By other dimensions they are those of the data. The cases are saved in the store, if there is one, as of
    the time that is given: the clock is never read.
    """
    if store and as_of is None:
        raise ScanError("a sweep that is saved needs as_of")
    dims = dims or ["region"]
    v = verify_all(model, contracts, dims, period, first, marks, as_of, kept)
    if dims == ["region"] and model.accounts is not None:
        kpis = model.accounts.sparkSession.createDataFrame([(c.id,) for c in contracts], "kpi string")
        wanted = regions(model.accounts).crossJoin(F.broadcast(kpis))  # the sweep's cases
        v = joined(wanted, v, ["kpi", "region"]).withColumn("status", F.coalesce("status", F.lit("unverifiable")))
    status = F.when(F.col("status") != "ok", "unverifiable").when(F.col("passed"), "open").otherwise("closed_at_verify")
    out = v.select(
        F.concat_ws("-", "kpi", F.lit(period), *(F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dims)).alias("case_id"),
        "kpi", F.lit(period).alias("period"), *dims, "value", "delta", "relative", status.alias("status"), "complete", "drifted", "artefact", "material", "ceiling",
    )
    if store:
        out = settled(out)
        _saved(store, out.withColumns({"driver": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string"), "priority": F.abs("delta")}), as_of)
    return out


def _saved(store: CaseStore, cases: DataFrame, as_of: datetime) -> None:
    store.save(store.numbered(cases.withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz"))))


def scan(model: Model, contracts: list[Contract], first: str, tables: Tables, marks: DataFrame, as_of: datetime, period: str | None = None, dims: list[str] | None = None, store: CaseStore | None = None) -> tuple[DataFrame, DataFrame]:
    """The sweep of each contract's latest closed period, or of a given one, and the investigation of all slices that it opens.

    Returns the cases, a row a slice with driver, confidence and priority of its first cause (null where it wasn't opened
    or no driver has a probe), and the verdicts of investigated(). All cases go to the store, each as the next version of
    what is there. Contracts of one period are swept together, so jobs grow with the periods and not with the slices.
    """
    dims = dims or ["region"]
    periods = dict.fromkeys((c.id for c in contracts), period) if period else closed_periods(marks, contracts)
    swept = [sweep(model, [c for c in contracts if periods[c.id] == p], p, first, dims, marks, as_of) for p in sorted(set(periods.values()))]
    cases = settled(functools.reduce(DataFrame.unionByName, swept))
    verdicts = settled(investigated(model, contracts, cases.where("status = 'open'"), tables, dims))
    best = verdicts.where("rank = 1").select("case_id", "driver", "confidence", "priority")
    out = cases.join(best, "case_id", "left").withColumn("priority", F.coalesce("priority", F.abs("delta")))
    if store:
        _saved(store, out, as_of)
    return out, verdicts


def summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("slices"), *(F.count_if(F.col("status") == s).alias(s) for s in ("open", "closed_at_verify", "unverifiable")))

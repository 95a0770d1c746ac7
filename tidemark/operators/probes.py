"""What each driver's probe counted, read as evidence items: what was found, what was looked for and is absent, what can't be checked."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.causes import Footprint, Tables, _segments
from tidemark.operators.evidence import SPIKE, EvidenceError, incident_scan, price_delta, reason_scan, sql_probe, ticket_spike
from tidemark.plans.contract import Driver

# The lost-reason codes that name a competitor, and how strong a fact and an absence of each probe are.
COMPETITOR_CODES = ("competitor_price", "competitor_features")
PRICE_FOUND, PRICE_ABSENT, REASON_ABSENT = 0.8, 0.6, 0.8
INCIDENT_FOUND, INCIDENT_ABSENT = 0.6, 0.5

SCHEMA = "about string, outcome string, supported boolean, strength double, denominator long, claim string"
_COLUMNS = [tuple(x.split()) for x in SCHEMA.split(", ")]


def _item(about: Column, outcome: Column, supported: Column, strength: Column, denominator: Column | None, claim: Column) -> list[Column]:
    return [about.cast("string").alias("about"), outcome.alias("outcome"), supported.alias("supported"), strength.cast("double").alias("strength"), (F.lit(None) if denominator is None else denominator).cast("long").alias("denominator"), claim.alias("claim")]


def _tickets(tables: Tables, at: Footprint) -> DataFrame:
    """An item an account: a spike supports, a quiet window contradicts, no tickets before can't be checked."""
    ratio, who = F.col("ratio"), F.col("account_id").cast("string")
    spikes = ticket_spike(tables["ticket"], at.accounts, str(at.start), str(at.end), str(at.baseline), str(at.start))
    strength = F.when(ratio.isNull(), 0.0).when(ratio >= SPIKE, F.least(F.lit(1.0), (ratio - 1) / 3)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio)))
    claim = F.when(ratio.isNull(), F.concat(who, F.lit(": no tickets before the window"))).otherwise(F.concat(who, F.lit(": tickets at "), F.call_function("format_number", ratio, F.lit("0.0")), F.lit(" times those before")))
    return spikes.select(*_item(who, F.when(ratio.isNull(), "uncheckable").otherwise("found"), F.coalesce(ratio >= SPIKE, F.lit(True)), strength, None, claim))


def _prices(tables: Tables, at: Footprint) -> DataFrame:
    """An item a segment of the footprint: prices that took effect in the window, or none of all that are on record."""
    found = price_delta(tables["price_book"], _segments(tables, at), str(at.start), str(at.end))
    there = F.col("outcome") == "found"
    claim = F.concat(F.col("n_changes").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" prices of "), F.col("segment"), F.lit(" took effect in the window"))
    return found.select(*_item(F.col("segment"), F.col("outcome"), there, F.when(there, PRICE_FOUND).otherwise(PRICE_ABSENT), F.when(~there, F.col("n_rows")), claim))


def _reasons(tables: Tables, at: Footprint) -> DataFrame:
    """One item: closed-lost opportunities of the footprint whose reason names a competitor."""
    mine = tables["opportunity"].join(at.accounts.select("account_id"), "account_id", "left_semi").where((F.to_date("close_date") >= F.lit(at.start)) & (F.to_date("close_date") < F.lit(at.end)))
    found = reason_scan(mine, [], F.col("closed_won") == 0, F.coalesce("lost_reason_code", F.lit("")), list(COMPETITOR_CODES))
    there, absent = F.col("outcome") == "found", F.col("outcome") == "checked_absent"
    claim = F.concat(F.col("names_cause").cast("string"), F.lit(" of "), F.col("populated").cast("string"), F.lit(" reasons given for lost opportunities name a competitor"))
    return found.select(*_item(F.lit("lost_reason_code"), F.col("outcome"), ~absent, F.when(there, F.col("share")).when(absent, REASON_ABSENT).otherwise(0.0), F.when(absent, F.col("populated")), claim))


def _incidents(tables: Tables, at: Footprint) -> DataFrame:
    """An item an incident that overlaps the window and names an account of the footprint; if there is none, one of their absence among all of the window."""
    hits = incident_scan(tables["incident"], at.accounts, str(at.start), str(at.end))
    each = hits.select(*_item(F.col("incident_id"), F.lit("found"), F.lit(True), F.lit(INCIDENT_FOUND), None, F.concat(F.lit("incident "), "incident_id", F.lit(" of "), "service", F.lit(" overlaps the window"))))
    inside = tables["incident"].where((F.col("started_at") < F.lit(at.end).cast("timestamp_ntz")) & (F.col("resolved_at") >= F.lit(at.start).cast("timestamp_ntz")))
    n = inside.agg(F.count("*").alias("n")).crossJoin(hits.agg(F.count("*").alias("hits"))).where("hits = 0")  # one row each
    return each.unionByName(n.select(*_item(F.lit("incident"), F.lit("checked_absent"), F.lit(False), F.lit(INCIDENT_ABSENT), F.col("n"), F.concat(F.lit("none of "), F.col("n").cast("string"), F.lit(" incidents of the window names these accounts")))))


READERS: dict[str, Callable[[Tables, Footprint], DataFrame]] = {"ticket_spike": _tickets, "price_delta": _prices, "lost_reason_scan": _reasons, "incident_scan": _incidents}
NEEDS = {"ticket_spike": ("ticket",), "price_delta": ("price_book", "account"), "lost_reason_scan": ("opportunity",), "incident_scan": ("incident",)}


def sql_items(spark: SparkSession, path: str, tables: Tables, values: dict[str, object], keys: list[str] | None = None) -> DataFrame:
    """The rows of a contract's own probe, a file of SQL, as items with the columns of SCHEMA, after those of keys. One that isn't there is an error."""
    rows, keys = sql_probe(spark, path, tables, values), keys or []
    if lacking := [n for n in (*keys, *(n for n, _ in _COLUMNS)) if n not in rows.columns]:
        raise EvidenceError(f"{path}: no column {', '.join(lacking)}")
    return rows.select(*keys, *(F.col(n).cast(t).alias(n) for n, t in _COLUMNS))


def evidence(tables: Tables, drivers: list[Driver], at: Footprint) -> DataFrame | None:
    """id, driver, outcome, supports, contradicts, method, strength, coverage, denominator, claim of all drivers' probes.

    An unregistered probe is an error; one whose tables aren't there gives one item that can't be checked. A probe that
    is the path of a .sql file is the contract's own: sql_probe() runs it with the tables, {footprint} and the dates :start and
    :end, and its rows are items with the columns of SCHEMA. In their place it may read {footprints}, with case_id, account_id,
    start and end, and keep case_id: so written, it serves one case here and any number in investigated().
    """
    parts = []
    for d in drivers:
        if not d.probe:
            continue
        if d.probe.endswith(".sql"):
            mine = {"footprint": at.accounts, "footprints": at.accounts.select(F.lit("").alias("case_id"), "account_id", F.lit(at.start).alias("start"), F.lit(at.end).alias("end"))}
            rows = sql_items(at.accounts.sparkSession, d.probe, tables | mine, {"start": at.start, "end": at.end})
            parts.append(rows.withColumn("driver", F.lit(d.id)))
            continue
        if d.probe not in READERS:
            raise EvidenceError(f"driver {d.id!r}: no reader of probe {d.probe!r}")
        lacking = [t for t in NEEDS[d.probe] if t not in tables]
        spark = at.accounts.sparkSession
        part = spark.createDataFrame([(d.probe, "uncheckable", True, 0.0, None, f"no {', '.join(lacking)} to look at")], SCHEMA) if lacking else READERS[d.probe](tables, at)
        parts.append(part.withColumn("driver", F.lit(d.id)))
    if not parts:
        return None
    return functools.reduce(DataFrame.unionByName, parts).select(
        F.concat(F.lit("ev-"), "driver", F.lit("-"), "about").alias("id"),
        "driver",
        "outcome",
        F.when(F.col("supported"), F.col("driver")).alias("supports"),
        F.when(~F.col("supported"), F.col("driver")).alias("contradicts"),
        F.lit("sql").alias("method"),
        "strength",
        F.when(F.col("outcome") == "uncheckable", 0.0).alias("coverage"),
        "denominator",
        "claim",
    )

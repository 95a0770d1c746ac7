"""Counted evidence: parameterised probes, their readings, and checks of quoted claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import quotes

#: A ratio of counts from here on is a spike.
SPIKE = 1.5


def ticket_spike(tickets: DataFrame, accounts: DataFrame, start: str, end: str, baseline_start: str, baseline_end: str) -> DataFrame:
    """account_id, window_count, baseline_count, ratio: both half-open windows in one conditional grouping; null ratio over 0."""
    at = F.col("created_at")
    inside = lambda a, b: (at >= F.lit(a).cast("timestamp_ntz")) & (at < F.lit(b).cast("timestamp_ntz"))
    now, before = inside(start, end), inside(baseline_start, baseline_end)
    out = tickets.where(now | before).join(accounts.select("account_id").distinct(), "account_id", "left_semi").groupBy("account_id").agg(F.count_if(now).alias("window_count"), F.count_if(before).alias("baseline_count"))
    return out.withColumn("ratio", F.try_divide(F.col("window_count").cast("double"), F.nullif(F.col("baseline_count").cast("double"), F.lit(0.0))))


def read_spike(spikes: DataFrame) -> DataFrame:
    """Adds outcome, supports and strength: spikes support, others contradict, no baseline can't be checked."""
    spike = F.col("ratio") >= SPIKE
    return (
        spikes.withColumn("outcome", F.when(F.col("ratio").isNull(), "uncheckable").otherwise("found"))
        .withColumn("supports", F.when(F.col("ratio").isNotNull(), spike))
        .withColumn("strength", F.when(spike, F.least(F.lit(1.0), (F.col("ratio") - 1) / 3)).otherwise(0.0))
    )


def price_delta(price_book: DataFrame, segments: DataFrame, start: str, end: str) -> DataFrame:
    """segment, n_rows, n_changes, outcome: list prices that took effect in the half-open window; none of all rows is a checked absence."""
    inside = (F.col("effective_from") >= F.lit(start).cast("date")) & (F.col("effective_from") < F.lit(end).cast("date"))
    out = price_book.join(segments.select("segment").distinct(), "segment", "left_semi").groupBy("segment").agg(F.count("*").alias("n_rows"), F.count_if(inside).alias("n_changes"))
    return out.withColumn("outcome", F.when(F.col("n_changes") > 0, "found").otherwise("checked_absent"))


def reason_scan(rows: DataFrame, by: list[str], lost: Column, reason: Column, named: list[str]) -> DataFrame:
    """Per `by`: closed_lost, populated, names_cause, outcome and share. Nothing populated can't be checked; none named is a checked absence."""
    filled = lost & (reason != "")
    out = rows.groupBy(*by).agg(F.count_if(lost).alias("closed_lost"), F.count_if(filled).alias("populated"), F.count_if(lost & reason.isin(*named)).alias("names_cause"))
    return out.withColumn("outcome", F.when(F.col("populated") == 0, "uncheckable").when(F.col("names_cause") == 0, "checked_absent").otherwise("found")).withColumn("share", F.try_divide(F.col("names_cause").cast("double"), F.nullif(F.col("populated").cast("double"), F.lit(0.0))))


def incident_scan(incidents: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct incidents that overlap the window and name one of the accounts in their list, joined by bars; an open one drops out."""
    there = incidents.where((F.col("started_at") < F.lit(end).cast("timestamp_ntz")) & (F.col("resolved_at") >= F.lit(start).cast("timestamp_ntz")))
    each = there.withColumn("account_id", F.explode(F.split("affected_accounts", r"\|")))
    known = accounts.select(F.col("account_id").cast("string").alias("account_id")).distinct()
    return each.join(known, "account_id", "left_semi").select("incident_id", "service", "started_at", "resolved_at", "severity").distinct()


PROBES: dict[str, Callable[..., DataFrame]] = {"ticket_spike": ticket_spike, "price_delta": price_delta, "lost_reason_scan": reason_scan, "incident_scan": incident_scan}


class EvidenceError(ValueError):
    """Evidence that no registered probe can gather."""


def probe(name: str) -> Callable[..., DataFrame]:
    if name not in PROBES:
        raise EvidenceError(f"no probe {name!r}; known are {', '.join(PROBES)}")
    return PROBES[name]


def sql_text(spark: SparkSession, path: str) -> str:
    """What a file of SQL says; one that isn't there is an error."""
    try:
        sql = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise EvidenceError(f"{path}: {e}") from e
    return sql.value if sql else ""


def sql_probe(spark: SparkSession, path: str, tables: dict[str, DataFrame], values: dict[str, object]) -> DataFrame:
    """The rows of a probe that is a file of SQL, which names its frames in braces, {ticket}, and its values by colons, :start.

    The accounts of a footprint are a frame too, however many there are. A file, frame or value that isn't there is an error.
    """
    try:
        return spark.sql(sql_text(spark, path), args=values, **tables)
    except (AnalysisException, KeyError) as e:
        raise EvidenceError(f"{path}: {e}") from e


def broken(items: DataFrame) -> DataFrame:
    """Evidence items that break an invariant, with why: id, outcome, denominator, coverage, method and quote are read."""
    why = F.array_compact(
        F.array(
            F.when((F.col("outcome") == "checked_absent") & F.col("denominator").isNull(), "absence without a denominator"),
            F.when((F.col("outcome") == "uncheckable") & F.col("coverage").isNull(), "uncheckable without a coverage"),
            F.when((F.col("outcome") == "found") & (F.col("method") == "extraction") & (F.coalesce("quote", F.lit("")) == ""), "extracted without a quote"),
            F.when(F.count("*").over(_by_id()) > 1, "an id that stands twice"),
        )
    )
    return items.withColumn("why", why).where(F.size("why") > 0)


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("id")


def supported_claims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims whose document was retrieved and has their quote, whatever the white space."""
    return claims.join(documents.select("doc_id", F.col("text").alias("_text")), "doc_id").where(quotes(F.col("_text"), F.col("quote"))).drop("_text")

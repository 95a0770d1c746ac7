"""Conformance of raw tables: keys, owners of a field, exclusions, the fiscal calendar and watermarks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first day of a fiscal year of 52 weeks, and the weeks of a quarter's three periods.
ANCHOR, WEEKS = date(2023, 3, 27), (4, 4, 5)


class ConformanceError(ValueError):
    """Raw data that can't be conformed without a decision."""


def conform_keys(df: DataFrame, alias: DataFrame, source: str, required: bool = True) -> DataFrame:
    """account_id by the alias map of a source; the raw key stays as source_account_id. An unmatched row is an error if required."""
    known = alias.where(F.col("source") == source).select(F.col("raw_id").alias("source_account_id"), F.col("account_id").alias("_conformed"))
    out = df.withColumnRenamed("account_id", "source_account_id").join(known, "source_account_id", "left")
    if required and (lost := out.where("_conformed IS NULL").select("source_account_id").distinct().limit(5).collect()):
        raise ConformanceError(f"no alias for {', '.join(str(r[0]) for r in lost)}")
    return out.withColumnRenamed("_conformed", "account_id")


def conform_field(df: DataFrame, owner: DataFrame, key: str, field: str) -> DataFrame:
    """field as its owner has it; the raw one stays as source_<field>, and overridden says whether they differ, nulls included."""
    other = owner.select(key, F.col(field).alias("_owned"))
    out = df.withColumnRenamed(field, f"source_{field}").join(other, key, "left")
    return out.withColumn("overridden", ~F.col(f"source_{field}").eqNullSafe(F.col("_owned"))).withColumnRenamed("_owned", field)


def flag_tests(accounts: DataFrame, listed: DataFrame) -> DataFrame:
    """is_test, by a list; a listed account that doesn't exist makes the list stale, which is an error."""
    names = listed.select("account_id").distinct()
    if names.join(accounts, "account_id", "left_anti").head(1):
        raise ConformanceError("the list of test accounts names accounts that don't exist")
    return accounts.join(names.withColumn("is_test", F.lit(True)), "account_id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def fiscal_calendar(spark: SparkSession, first: date, last: date, anchor: date = ANCHOR) -> DataFrame:
    """One row a day: fiscal_year (named by the year after it begins), quarter, period, period_label FYyyyy-Ppp and week, 1 to 52.

    Arithmetic on the number of days since the anchor; years of 52 weeks, quarters of 4, 4 and 5.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    week = F.floor(F.datediff("day", F.lit(anchor)) / 7)
    year, in_year = F.floor(week / 52), F.pmod(week, F.lit(52))
    quarter, in_quarter = F.floor(in_year / 13), F.pmod(in_year, F.lit(13))
    part = F.when(in_quarter < WEEKS[0], 0).when(in_quarter < WEEKS[0] + WEEKS[1], 1).otherwise(2)
    out = days.select("day", (year + anchor.year + 1).cast("int").alias("fiscal_year"), (quarter + 1).cast("int").alias("fiscal_quarter"), (quarter * 3 + part + 1).cast("int").alias("fiscal_period"), (in_year + 1).cast("int").alias("fiscal_week"))
    label = F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit("-P"), F.lpad(F.col("fiscal_period").cast("string"), 2, "0"))
    return out.withColumn("period_label", label)


def watermarks(tables: dict[str, tuple[str, DataFrame, str | None]], as_of: datetime | None = None) -> DataFrame:
    """source, watermark, n_rows (and as_of): the newest ingest time and the rows of each source's tables that have one.

    tables: name to (source, rows, ingest column). as_of is a parameter, never the clock.
    """
    parts = [df.agg(F.max(F.col(c).cast("timestamp_ntz")).alias("watermark"), F.count("*").alias("n_rows")).select(F.lit(source).alias("source"), "watermark", "n_rows") for source, df, c in tables.values() if c]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("source").agg(F.max("watermark").alias("watermark"), F.sum("n_rows").alias("n_rows"))
    return out if as_of is None else out.withColumn("as_of", F.lit(as_of).cast("timestamp_ntz"))

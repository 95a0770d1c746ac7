"""Order statistics and ranks of groups of any size, without a task or a row that has a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.panel import joined
from tidemark.sources.scratch import settled

#: So many distinct values of a group are put in order in one task; of more, a pass narrows them down first.
LIMIT = 50_000
#: Steps of a pass: the values asked for are then among about 3 of so many parts of a group's rows.
STEPS = 200


def _counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, v, n: each distinct value with its number of rows, added up before anything moves."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: Callable[[Column], dict[str, Column]], limit: int | None = None) -> DataFrame:
    """by, n and the values at some ranks of each group, by name: exact, ties counted, nulls left out.

    ranks: from the number of values to names with places, from 1 on; a place outside is null. Rows are added up by distinct value first. While a group has
    more than `limit` of them between its least and its greatest place, a pass takes a mergeable sketch of quantiles and
    keeps the values around these places; counts prove what is below, so the sketch decides only how many passes it takes.
    """
    if not by:
        return at_ranks(df.withColumn("_one", F.lit(0)), ["_one"], value, ranks, limit).drop("_one")
    limit, counts = LIMIT if limit is None else limit, settled(_counts(df, by, value))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_all"), F.count("*").alias("_distinct"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    places = ranks(F.col("_all"))
    names, cols = list(places), [p.cast("long") for p in places.values()]
    least, most = (F.least(*cols), F.greatest(*cols)) if len(cols) > 1 else (cols[0], cols[0])
    state = settled(sizes.withColumns({"_below": F.lit(0).cast("long"), "_inside": F.col("_all"), "_first": F.greatest(least, F.lit(1)), "_last": F.least(most, F.col("_all"))}))
    while state.where(F.col("_distinct") > limit).head(1):
        wide = state.where(F.col("_distinct") > limit)
        near = joined(counts, wide.select(*by, "_low", "_high"), by, "inner").where(F.col("v").between(F.col("_low"), F.col("_high")))
        grid = near.groupBy(*by).agg(F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], 10 * STEPS).alias("_grid"))
        # which steps have the places is counted, as values weigh by their rows
        cut = joined(near, grid, by, "inner").withColumn("_step", F.size(F.filter("_grid", lambda g: g < F.col("v"))))
        steps = cut.groupBy(*by, "_step").agg(F.sum("n").alias("_rows"), F.count("*").alias("_values"), F.min("v").alias("_from"), F.max("v").alias("_to"))
        w = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
        placed = joined(steps, wide.select(*by, "_below", "_first", "_last"), by, "inner").withColumn("_before", F.col("_below") + F.coalesce(F.sum("_rows").over(w), F.lit(0)))
        held = placed.where((F.col("_before") < F.col("_last")) & (F.col("_before") + F.col("_rows") >= F.col("_first")))
        new = held.groupBy(*by).agg(F.min("_from").alias("_low"), F.max("_to").alias("_high"), F.min("_before").alias("_below"), F.sum("_rows").alias("_inside"), F.sum("_values").alias("_distinct"))
        next_ = joined(wide.drop("_low", "_high", "_below", "_inside", "_distinct"), new, by, "inner").select(*state.columns)
        before = wide.agg(F.sum("_distinct")).first()[0]
        state = settled(state.where(F.col("_distinct") <= limit).unionByName(next_))
        if state.where(F.col("_distinct") > limit).agg(F.sum("_distinct")).first()[0] == before:
            break  # no step could be told from another: the rest is put in order as it is
    near = joined(counts, state.select(*by, "_low", "_high", "_below", "_all"), by, "inner").where(F.col("v").between(F.col("_low"), F.col("_high")))
    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = near.withColumn("_upto", F.col("_below") + F.sum("n").over(w))
    hit = lambda p: F.max(F.when((p > F.col("_upto") - F.col("n")) & (p <= F.col("_upto")), F.col("v")))
    out = upto.groupBy(*by).agg(F.first("_all").alias("n"), *(hit(p).alias(name) for name, p in zip(names, cols, strict=True)))
    return out


def median_selected(df: DataFrame, by: list[str], value: str, limit: int | None = None) -> DataFrame:
    """by, n, median: the exact median of each group, as median() has it."""
    two = at_ranks(df, by, value, lambda n: {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1}, limit)
    return two.select(*by, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def mean_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, rank, n: each distinct value of each group with its mean rank among all of the group's rows, and how many rows have it.

    Distinct values are dealt out by ranges of group and value and written in order; a value's rank is what its own file
    has before it and what the files before have. What is added up over files is a row a group and file.
    """
    if not by:
        return mean_ranks(df.withColumn("_one", F.lit(0)), ["_one"], value).drop("_one")
    written = settled(_counts(df, by, value).orderBy(*by, "v"))
    at = written.metadataColumn("_metadata")
    placed = written.select("*", F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).cast("int").alias("_file"))
    files = placed.groupBy(*by, "_file").agg(F.sum("n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(*by, "_file", before.alias("_before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_file", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = joined(placed.withColumn("_own", own), files, [*by, "_file"], "inner")
    return out.select(*by, F.col("v").alias(value), (F.col("_before") + F.col("_own") + (F.col("n") + 1) / 2).alias("rank"), "n")

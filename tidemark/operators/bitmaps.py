"""Sets of accounts as bitmaps in chunks, which merge, and their overlaps from bit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """by, chunk, bits: the distinct numbers (0 or more; null and negative ones are left out) of each set, some 32,000 to a chunk of at most 4 kB."""
    rows = df.where(F.col(number) >= 0)
    return rows.groupBy(by, F.bitmap_bucket_number(F.col(number)).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias("bits"))


def merged(sets: DataFrame, by: str) -> DataFrame:
    """One bitmap a set and chunk, of bitmaps of several days or batches."""
    return sets.groupBy(by, "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def overlaps(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """a, b, n_a, n_b, n_both, overlap: every set of left against every set of right, both as bitmaps() has them.

    Sets are a contract's causes and effects, which are few; their chunks meet by number. What is shared in a chunk is the
    two counts less that of the bits of either. The overlap of two empty sets is null, but a set without a number isn't here.
    """
    one = lambda df, name, n: df.groupBy(F.col(by).alias(name)).agg(F.sum(F.bitmap_count("bits")).alias(n))
    pairs = one(left, "a", "n_a").crossJoin(one(right, "b", "n_b"))  # a row a set each
    both = left.select(F.col(by).alias("a"), "chunk", F.col("bits").alias("x")).join(right.select(F.col(by).alias("b"), "chunk", F.col("bits").alias("y")), "chunk")
    count = F.bitmap_count("x") + F.bitmap_count("y")
    either = both.select("a", "b", "chunk", count.alias("n"), F.explode(F.array("x", "y")).alias("bits")).groupBy("a", "b", "chunk").agg(F.first("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    shared = either.groupBy("a", "b").agg(F.sum(F.col("n") - F.bitmap_count("bits")).alias("n_both"))
    out = pairs.join(shared, ["a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0).cast("long")))
    return out.withColumn("overlap", F.try_divide(F.col("n_both").cast("double"), F.nullif((F.col("n_a") + F.col("n_b") - F.col("n_both")).cast("double"), F.lit(0.0))))

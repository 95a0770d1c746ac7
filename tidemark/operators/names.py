"""Names of accounts taken out of prose, by a table of names of any size instead of one pattern on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import alias
from tidemark.sources.scratch import settled

_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Words and gaps of the longest name. The lengths that occur are read on the driver, at most so many.
LONGEST = 31


def _pieces(text: Column) -> Column:
    """A text as words and what is between them, in order; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _text(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def name_table(names: DataFrame) -> DataFrame:
    """gram, length, account_id: each name (account_id, name) in lower case without what stands before its first and after its last word.

    A name that several accounts have is the least account's. A name without a word names nobody.
    """
    bare = F.regexp_replace(F.lower("name"), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    rows = names.select(bare.alias("gram"), "account_id").where("gram <> ''")
    return rows.groupBy("gram").agg(F.min("account_id").alias("account_id")).withColumn("length", F.size(_pieces(F.col("gram"))))


def without_names(docs: DataFrame, names: DataFrame, column: str = "text", replacement: Column | None = None) -> DataFrame:
    """docs with each name in the column replaced by its account's alias, or by `replacement` (over account_id, length and gram).

    A name stands where its words and gaps are, in any case, and no letter, digit or underscore touches it. Of names that
    overlap, the first in the text counts, and of those the longest. Two names of one account get one alias. Other columns
    and texts without a name stay as they are; null stays null.

    Each word of a text starts as many candidates as names have lengths; they meet the names by a plain join on their
    characters. What is gathered is a text's own matches.
    """
    known = settled(name_table(names))
    lengths = sorted(r.length for r in known.select("length").distinct().limit(LONGEST + 1).collect())
    if lengths and (lengths[-1] > LONGEST or len(lengths) > LONGEST):
        raise ValueError(f"a name has more than {LONGEST} words and gaps")
    if not lengths:
        return docs
    rows = settled(docs.withColumn("_row", F.monotonically_increasing_id()))
    split = rows.where(F.col(column).isNotNull()).select("_row", _pieces(F.col(column)).alias("p"))
    starts = split.select("_row", "p", F.posexplode("p").alias("i", "first")).where(F.col("first").rlike(r"^[\p{L}\p{N}_]"))
    each = starts.select("_row", (F.col("i") + 1).alias("i"), "p", F.explode(F.array(*map(F.lit, lengths))).alias("length")).where(F.col("i") + F.col("length") - 1 <= F.size("p"))
    grams = each.select("_row", "i", F.lower(_text(F.slice("p", F.col("i"), F.col("length")))).alias("gram"))
    hits = grams.join(known, "gram").select("_row", F.struct("i", (-F.col("length")).alias("less"), (replacement if replacement is not None else alias(F.col("account_id"))).alias("to")).alias("hit"))
    found = hits.groupBy("_row").agg(F.array_sort(F.collect_list("hit")).alias("_hits"))  # a text's own
    p = _pieces(F.col(column))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    take = lambda s, h: F.when(h["i"] >= s["at"], F.struct((h["i"] - h["less"]).alias("at"), F.concat(s["out"], _text(F.slice(p, s["at"], h["i"] - s["at"])), h["to"]).alias("out"))).otherwise(s)
    done = F.aggregate("_hits", start, take, lambda s: F.concat(s["out"], _text(F.slice(p, s["at"], F.size(p) - s["at"] + 1))))
    return rows.join(found, "_row", "left").withColumn(column, F.when(F.col("_hits").isNotNull(), done).otherwise(F.col(column))).select(*docs.columns)

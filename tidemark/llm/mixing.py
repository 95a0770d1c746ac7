"""Operator 2: mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import PLACE, WORD, located, looked_up, shared_dir, written

#: A document is taken at most this many times.
MOST = 3
#: About as many fractional documents are rounded one after the other in a step of the reduction tree.
FAN_IN = 64


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts)), 11) / F.lit(float(2**53))


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], folder: str) -> DataFrame:
    """df with the sums of columns over all rows before each, in an order without ties.

    Rows are dealt out by ranges of the order and written, which fixes the ranges; then only a row for each
    range, of which there are as many as shuffle partitions, meets the others in one task.
    """
    ranged = written(df.withColumns(sums).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), folder)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*(F.sum(n).alias(n) for n in sums))
    start = whole.select("_range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(start), "_range").select(*df.columns, *((F.col(f"_{n}") + F.coalesce(F.sum(n).over(within), F.lit(0))).alias(n) for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """sizes: source and source_size, one row a source, and any others. Adds target.

    Sources in order of code points, null last, weigh as weights say, repeating. A source's target is its
    share of the sum of all sizes, at most `most` times its size; what is above is shared anew by weight. The
    fixed point is min(cap, level * weight): sorted by cap over weight, the level is found with running sums.
    No task sees more than a range of the sources, so there may be as many as there are hosts.
    """
    folder, by_name = shared_dir(sizes.sparkSession), [F.col("source").isNull(), F.encode("source", "UTF-8")]
    ranked = _running(sizes, by_name, {"rank": F.lit(1)}, f"{folder}/names")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.select(*sizes.columns, weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    by_cap = [F.col("cap") / F.col("weight"), *by_name]
    before = _running(weighed, by_cap, {"place": F.lit(1), "capped": F.col("cap"), "weighed": F.col("weight")}, f"{folder}/caps")
    # the level if all sources before are at their cap and none after; the first source that isn't over its cap at its level sets that of all after it
    total = weighed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    filled = before.crossJoin(F.broadcast(total)).withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("weighed")))
    first = filled.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("place", "level"))["level"].alias("level"))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double"))
    return weighed.crossJoin(F.broadcast(first)).select(*sizes.columns, target.alias("target"))


def _block_rounded(items: Column, seed: int, level: int) -> Column:
    """Rounds the documents of a block one after the other: struct of done, an array of (doc_id, place, size, whole), and held, the one left.

    items: array of (order, doc_id, place, key, size, mass), not empty; mass is size times the fraction of a copy
    that is still open. Of the held document and the next, mass goes from one to the other until one has none
    or is whole. The direction is drawn with odds that leave each one's expected mass as it was, and the sum
    of masses never changes.
    """

    def step(state: Column, other: Column) -> Column:
        held = state["held"]
        up, down = F.least(held["size"] - held["mass"], other["mass"]), F.least(held["mass"], other["size"] - other["mass"])
        rises = _uniform(seed, level, held["key"], other["key"], held["order"]) * (up + down) < down
        # a rising document ends when it is whole, a falling one when it is empty
        held_ends = F.when(rises, up == held["size"] - held["mass"]).otherwise(down == held["mass"])
        move = F.when(rises, up).otherwise(-down)
        field = lambda name: F.when(held_ends, other[name]).otherwise(held[name]).alias(name)
        gone = lambda name: F.when(held_ends, held[name]).otherwise(other[name]).alias(name)
        return F.struct(
            F.concat(state["done"], F.array(F.struct(gone("doc_id"), gone("place"), gone("size"), (rises == held_ends).alias("whole")))).alias("done"),
            F.struct(*map(field, ("order", "doc_id", "place", "key", "size")), F.when(held_ends, other["mass"] - move).otherwise(held["mass"] + move).alias("mass")).alias("held"),
        )

    none = F.expr(f"cast(array() AS array<struct<doc_id: long, place: {PLACE}, size: long, whole: boolean>>)")
    return F.aggregate(F.slice(items, 2, F.lit(2**30)), F.struct(none.alias("done"), items[0].alias("held")), step)


def _keyed(sized: DataFrame, total: int, folder: str) -> DataFrame:
    """sized with key, what draws are made from: a hash of doc_id and text, and of the place too where rows repeat both.

    So draws don't depend on how rows are laid out in files, and many rows of one id and one text, which are
    as good as each other, still get different keys and spread over blocks.
    """
    repeated = written(sized.groupBy("same").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/repeated")
    if not repeated.head(1):
        return sized.withColumnRenamed("same", "key")
    key = F.when(F.col("n").isNull(), F.col("same")).otherwise(F.xxhash64("same", "place.file", "place.row"))
    return looked_up(sized, repeated, "same", "n", total).withColumn("key", key).drop("same", "n")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies, cut_to.

    size is the number of words of the text (null: none), source_size and target its source's, see targets().
    copies is how often the whole document is taken; the one document of a source that the rounding leaves
    fractional is also taken up to its first cut_to words, so a source's taken words are its target up to half
    a word, and taken, the words in all, is at most 3 times size.

    Every document of a source has the same expected number of copies. Its fractional part is rounded by the
    pivotal method in blocks of about fan_in documents; what a block leaves over goes on to the next level of
    the tree. Blocks and draws depend on doc_id, text and seed, so reruns agree; rows that repeat id and text,
    null ids included, are told apart by where they are in their file. Null sources are one source;
    null ids and repeated rows are documents of their own; no row gives no result. Extra columns are ignored.
    """
    folder = shared_dir(docs.sparkSession)
    return _mix(located(docs, f"{folder}/rows"), folder, weights, seed, fan_in).drop("place")


def _mix(placed: DataFrame, folder: str, weights: tuple[int, ...], seed: int, fan_in: int = FAN_IN) -> DataFrame:
    """mix() with the place of each row."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    doc_id = F.col("row.doc_id").cast("long")
    sized = placed.select(
        doc_id.alias("doc_id"),
        "place",
        F.col("row.source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(doc_id.isNull(), doc_id, text).alias("same"),
    )
    sized = written(sized, f"{folder}/sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("filled"), F.count("*").alias("n_rows"))
    plan = targets(sources, weights).withColumn("times", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    at = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source has a key too
    plan = written(plan.withColumn("at", at).drop("source"), f"{folder}/plan")
    most, total = plan.agg(F.max("filled"), F.sum("n_rows")).first()
    rows = looked_up(_keyed(sized, total or 0, folder).withColumn("at", at), plan, "at", "n_rows", total or 0).drop("at", "n_rows")
    rows = rows.withColumn("whole", F.floor("times")).withColumn("open", F.col("times") - F.col("whole"))
    fractional = (F.col("open") > 0) & (F.col("size") > 0)
    known = ["source_size", "target", "whole"]
    final = ["doc_id", "place", "size", *known]
    out = rows.where(~fractional).select(*final, F.lit(0).alias("more"), F.lit(0.0).alias("mass"))
    state = rows.where(fractional).select("source", *known, F.ceil(F.col("filled") / fan_in).alias("blocks"), "doc_id", "place", "key", "size", (F.col("size") * F.col("open")).alias("mass"))
    level, left = 0, most or 0
    while left:
        left = -(-left // fan_in)
        order = F.xxhash64(F.lit(seed), F.lit(level), F.col("key"))
        block = state.groupBy("source", *known, "blocks", F.pmod(F.shiftright(order, 8), F.col("blocks")).alias("block"))
        items = F.array_sort(F.collect_list(F.struct(order.alias("order"), "doc_id", "place", "key", "size", "mass")))
        ended = written(block.agg(_block_rounded(items, seed, level).alias("r")).select("source", *known, "blocks", "r.*"), f"{folder}/level-{level}")
        each = ended.select(*known, F.explode("done").alias("d"))
        out = out.unionByName(each.select("d.doc_id", "d.place", "d.size", *known, F.col("d.whole").cast("int").alias("more"), F.lit(0.0).alias("mass")))
        state = ended.select("source", *known, F.ceil(F.col("blocks") / fan_in).alias("blocks"), "held.doc_id", "held.place", "held.key", "held.size", "held.mass")
        level += 1
        if left == 1:
            break
    if level:
        out = out.unionByName(state.select(*final, F.lit(0).alias("more"), "mass"))
    cut = F.round("mass").cast("long")
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        ((F.col("whole") + F.col("more")) * F.col("size") + cut).cast("long").alias("taken"),
        (F.col("whole") + F.col("more")).cast("int").alias("copies"),
        cut.alias("cut_to"),
        "place",
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """The rows of the mix with all columns of docs, whatever these are called: each document as often as it is taken, the cut one shortened.

    What null and repeated ids, null texts and sources, and empty tables give, see mix(). A null or empty text has no word and isn't taken.
    """
    folder = shared_dir(docs.sparkSession)
    placed = located(docs, f"{folder}/rows")
    plan = _mix(placed, folder, weights, seed).where("taken > 0").select("place", "copies", "cut_to")
    rows = placed.join(plan, "place")
    starts = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    whole = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
    part = F.array_join(F.slice(starts, F.lit(1), F.col("cut_to").cast("int")), "")
    cut = rows.where("cut_to > 0").select(F.col("row").withField("text", part).alias("row")).select("row.*")
    return whole.unionByName(cut)

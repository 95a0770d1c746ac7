"""Where a movement comes from: contributions by dimension, coverage, nesting, concentration, baskets and partitions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_sum
from tidemark.operators.series import price_volume_mix
from tidemark.plans.contract import Contract
from tidemark.plans.formula import parse
from tidemark.plans.panel import Model, _filters, joined, labelled, scoped, term_panel, valued
from tidemark.sources.scratch import settled

#: Leading keys explain a movement up to this share; trees are this deep; a residual up to this is none.
COVERAGE, DEPTH, TOLERANCE = 0.8, 3, 0.02


def pair(model: Model, contract: Contract, dims: list[str], current: str, previous: str) -> DataFrame:
    """For each slice: num0, den0, num1, den1 of two periods, in one grouping; a missing side is 0.

    Sums are exact: leading keys are put in order by their changes and those without one drop out, which rounding that
    hangs on the order of rows would decide where keys have the same rows.
    """
    formula = parse(contract.formula, frozenset(model.facts))
    terms, names = term_panel(model, contract, [formula], dims, months=(previous, current), exact=True)
    num, den, _ = valued(formula, names)
    two = terms.where(F.col("period").isin(current, previous)).select("period", *dims, num.alias("num"), den.alias("den"))

    def of(column: str, period: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == period, F.col(column))), F.lit(0.0))

    return two.groupBy(*dims).agg(of("num", previous).alias("num0"), of("den", previous).alias("den0"), of("num", current).alias("num1"), of("den", current).alias("den1"))


def _adds_up(contract: Contract) -> bool:
    """Whether numerator and denominator over parts add up to the whole's: then the finest slices are enough for all others."""
    return all(t.aggregate in ("SUM", "COUNT") for t in contract.parsed.terms)


def _over_whole(contract: Contract, sides: DataFrame, whole: DataFrame) -> DataFrame:
    """Adds delta to rows with num0 and num1: for a ratio, the numerators over the whole's denominators, so parts add up to the ratio's movement."""
    formula = contract.parsed
    if not formula.denominator:
        return sides.withColumn("delta", (F.col("num1") - F.col("num0")) / F.lit(formula.divisor))
    one = whole.agg(F.sum("den0").alias("_d0"), F.sum("den1").alias("_d1"))
    part = lambda i: F.coalesce(F.try_divide(f"num{i}", F.nullif(f"_d{i}", F.lit(0.0))), F.lit(0.0))
    return sides.crossJoin(F.broadcast(one)).withColumn("delta", (part(1) - part(0)) / F.lit(formula.divisor)).drop("_d0", "_d1")  # one row


def contributions(model: Model, contract: Contract, dims: list[str], current: str, previous: str, fine: DataFrame | None = None) -> DataFrame:
    """dimension, key, delta, share for every key of every dimension with a change; share is of the whole's movement.

    For sums and counts, the finest slices are added up once and each dimension is a grouping set of them. A ratio's
    key counts with its numerators over the whole's denominators. So the keys of a dimension add up to the whole.
    Medians and means of parts don't: those are taken of each key's own rows, and the whole's movement is its own, too.
    """
    sides = ("num0", "num1")
    if _adds_up(contract):
        whole = fine = fine or settled(pair(model, contract, dims, current, previous))
        one = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dims)))
        parts = fine.withColumn("k", one).groupBy("k.dimension", "k.key").agg(*(exact_sum(F.col(c)).alias(c) for c in sides))
    else:
        whole = pair(model, contract, [], current, previous)
        each = [pair(model, contract, [d], current, previous).select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key"), *sides) for d in dims]
        parts = functools.reduce(DataFrame.unionByName, each)
    keys = _over_whole(contract, parts, whole).select("dimension", "key", "delta")
    if _adds_up(contract):
        totals = keys.groupBy("dimension").agg(F.sum("delta").alias("_total"))
    else:
        own = _over_whole(contract, whole.agg(*(F.sum(c).alias(c) for c in ("num0", "num1", "den0", "den1"))), whole)
        totals = own.select(F.explode(F.array(*map(F.lit, dims))).alias("dimension"), F.col("delta").alias("_total"))
    out = keys.join(F.broadcast(totals), "dimension")  # a row a dimension
    return out.withColumn("share", F.try_divide("delta", F.nullif("_total", F.lit(0.0)))).drop("_total").where("delta <> 0")


#: Keys of about the same size of change are in one step of this many to the doubling.
STEPS = 64


def covering(nodes: DataFrame, by: list[str], key: str = "key", coverage: float = COVERAGE) -> DataFrame:
    """The leading keys by size, of each group, up to the one with which they reach the coverage of all changes' sizes.

    Sizes are first added up by their step, of which there are few; only the keys of the step in which the coverage
    is reached are put in order.
    """
    size, step = F.abs("delta"), F.floor(F.log2(F.abs("delta")) * STEPS)
    stepped = nodes.where("delta <> 0").withColumn("_step", step)
    sums = stepped.groupBy(*by, "_step").agg(F.sum(size).alias("_size"))
    w = Window.partitionBy(*by)
    sums = sums.withColumn("_all", F.sum("_size").over(w)).withColumn("_before", F.coalesce(F.sum("_size").over(w.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    placed = joined(stepped, sums.where(F.col("_before") / F.col("_all") < coverage), [*by, "_step"], "inner")
    inner = Window.partitionBy(*by, "_step").orderBy(F.desc(size), key).rowsBetween(Window.unboundedPreceding, -1)
    reached = (F.col("_before") + F.col("_size")) / F.col("_all") >= coverage
    last = placed.where(reached).withColumn("_own", F.coalesce(F.sum(size).over(inner), F.lit(0.0)))
    out = placed.where(~reached).unionByName(last.where((F.col("_before") + F.col("_own")) / F.col("_all") < coverage).drop("_own"))
    return out.drop("_step", "_size", "_all", "_before")


def concentration(nodes: DataFrame, by: list[str], top: int = 2) -> DataFrame:
    """by, top_share (the leading keys' part of all changes' sizes), hhi (sum of squared shares), effective_keys (1 / hhi)."""
    size = F.abs("delta")
    sums = nodes.groupBy(*by).agg(F.sum(size).alias("_size"), F.try_divide(F.sum(F.col("delta") * F.col("delta")), F.nullif(F.sum("delta") * F.sum("delta"), F.lit(0.0))).alias("hhi"))
    leading = nodes.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(size), "key"))).where(F.col("_n") <= top)
    out = joined(sums, leading.groupBy(*by).agg(F.sum(size).alias("_top")), by)
    return out.select(*by, F.try_divide("_top", F.nullif("_size", F.lit(0.0))).alias("top_share"), "hhi", F.when(F.col("hhi") > 0, 1 / F.col("hhi")).alias("effective_keys"))


def tree(model: Model, contract: Contract, dims: list[str], current: str, previous: str, depth: int = DEPTH) -> DataFrame:
    """path (array of keys), depth, dimension, delta, share (of the parent's change): all keys of the first dimension, and below covering ones, those that cover them.

    Dimensions come in order of their concentration. For sums, counts and their ratios, the finest slices are added up
    once and each level groups them by one dimension more; medians and means are taken of each level's own rows. Ratios
    count as in contributions(): over the whole's denominators at every level.
    """
    fine = settled(pair(model, contract, dims, current, previous)) if _adds_up(contract) else None
    nodes = settled(contributions(model, contract, dims, current, previous, fine))
    order = [r.dimension for r in concentration(nodes, ["dimension"]).orderBy(F.desc("top_share"), "dimension").limit(depth).collect()]  # a name for each level
    whole = fine if _adds_up(contract) else pair(model, contract, [], current, previous)
    out, parents = None, None
    for level in range(1, len(order) + 1):
        on = order[:level]
        rows = fine if _adds_up(contract) else pair(model, contract, on, current, previous)
        sides = rows.groupBy(*(F.col(d).cast("string").alias(d) for d in on)).agg(*(exact_sum(F.col(c)).alias(c) for c in ("num0", "num1")))
        now = _over_whole(contract, sides, whole).select(*on, "delta").where("delta <> 0")
        if parents is None:
            of = nodes.where(F.col("dimension") == on[0]).select(F.col("key").alias(on[0]), "share")
            now = joined(now, of, on)
        else:
            now = covering(joined(now, parents.withColumnRenamed("delta", "_of"), on[:-1], "inner"), on[:-1], on[-1])
            now = now.withColumn("share", F.try_divide("delta", F.nullif("_of", F.lit(0.0)))).drop("_of")
        now = settled(now)
        row = now.select(F.array(*on).alias("path"), F.lit(level).alias("depth"), F.lit(on[-1]).alias("dimension"), "delta", "share")
        out = row if out is None else out.unionByName(row)
        parents = (covering(now, [], on[0]) if level == 1 else now).select(*on, "delta")
    return out


def footprint(nodes: DataFrame, dimension: str = "account_id") -> DataFrame:
    """key and delta of the accounts that cover the movement."""
    return covering(nodes.where(F.col("dimension") == dimension), ["dimension"]).select("key", "delta")


def basket(lines: DataFrame, by: list[str], item: list[str], current: str, previous: str, qty: str = "qty", amount: str = "amount_net") -> DataFrame:
    """q0, p0, q1, p1 for each item: quantities, and prices as amount by quantity; a side without quantity is absent."""
    sums = lines.where(F.col("period").isin(current, previous)).groupBy(*by, *item).agg(
        *(F.sum(F.when(F.col("period") == p, F.col(c))).alias(f"{n}{i}") for i, p in enumerate((previous, current)) for n, c in (("q", qty), ("a", amount)))
    )
    there = [F.coalesce(F.col(f"q{i}"), F.lit(0.0)) != 0 for i in (0, 1)]
    cols = [F.when(there[i], F.col(f"q{i}").cast("double")).alias(f"q{i}") for i in (0, 1)] + [F.when(there[i], F.col(f"a{i}") / F.col(f"q{i}")).alias(f"p{i}") for i in (0, 1)]
    return sums.where(there[0] | there[1]).select(*by, *item, *cols)


def pvm(model: Model, table: str, by: list[str], current: str, previous: str) -> DataFrame:
    """price, volume, mix, total and residual of a fact by account and product. As defined, contract filters don't apply."""
    lines = labelled(scoped(model, table, [], by, months=(previous, current)))
    return price_volume_mix(basket(lines, by, ["account_id", "product_id"], current, previous), by)


def partition(changes: DataFrame, owners: list[tuple[str, DataFrame]], rest: str = "non_recurring") -> DataFrame:
    """bucket, delta, share: each account's recurring change goes to the first owner whose accounts have it, all else to rest.

    changes: account_id, recurring, other. owners: (name, accounts) in order of precedence.
    """
    flagged = changes
    for i, (_, ids) in enumerate(owners):
        flagged = flagged.join(ids.select("account_id").distinct().withColumn(f"_o{i}", F.lit(True)), "account_id", "left")
    bucket = F.lit(rest)
    for i, (name, _) in reversed(list(enumerate(owners))):
        bucket = F.when(F.col(f"_o{i}"), F.lit(name)).otherwise(bucket)
    each = flagged.select(F.inline(F.array(F.struct(bucket.alias("bucket"), F.coalesce("recurring", F.lit(0.0)).alias("delta")), F.struct(F.lit(rest).alias("bucket"), F.coalesce("other", F.lit(0.0)).alias("delta")))))
    out = each.groupBy("bucket").agg(F.sum("delta").alias("delta"))
    return out.withColumn("share", F.try_divide("delta", F.nullif(F.sum("delta").over(Window.partitionBy()), F.lit(0.0))))


def recurring_changes(lines: DataFrame, current: str, previous: str, amount: str = "amount_net") -> DataFrame:
    """account_id, recurring, other: the change of each account between two periods, in one grouping."""
    sign = F.when(F.col("period") == current, 1).otherwise(-1)
    part = lambda flag: F.sum(F.when(F.col("is_recurring") == flag, sign * F.col(amount)))
    return lines.where(F.col("period").isin(current, previous)).groupBy("account_id").agg(part(1).alias("recurring"), part(0).alias("other"))


def residual(nodes: DataFrame, total: float) -> DataFrame:
    """residual and within: what the nodes leave unexplained, against the tolerance."""
    left = F.abs(F.lit(total) - F.coalesce(F.sum("delta"), F.lit(0.0))) / F.nullif(F.abs(F.lit(total)), F.lit(0.0))
    return nodes.agg(left.alias("residual")).withColumn("within", F.col("residual") <= TOLERANCE)


def display(nodes: DataFrame, rows: int = 8) -> DataFrame:
    """dimension, key, share: the first rows of each dimension by size of share; the others as one row with their number."""
    w = Window.partitionBy("dimension").orderBy(F.desc(F.abs("share")), "key")
    head = nodes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows).select("dimension", "key", F.abs("share").alias("share"), F.lit(1).cast("long").alias("n_keys"))
    shown = head.groupBy("dimension").agg(F.sum("share").alias("_share"), F.count("*").alias("_keys"))
    tail = nodes.groupBy("dimension").agg(F.sum(F.abs("share")).alias("share"), F.count("*").alias("n_keys")).join(F.broadcast(shown), "dimension").where("n_keys > _keys")  # a row a dimension
    return head.unionByName(tail.select("dimension", F.lit("others").alias("key"), (F.col("share") - F.col("_share")).alias("share"), (F.col("n_keys") - F.col("_keys")).alias("n_keys")))


def kept_filters(model: Model, contract: Contract) -> dict[str, list[str]]:
    return _filters(model, contract, [parse(contract.formula)])

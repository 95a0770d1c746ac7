"""One more period of billing, continued from the last: the same rows a month on, with usage that varies by a hash of its keys."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.panel import Model
from tidemark.sources.scratch import settled

#: How far usage may move from the month before, in quantity and in price.
QUANTITY, PRICE = 0.04, 0.02


def _noise(seed: int, salt: str, *keys: str) -> Column:
    """In [-1, 1], by the keys alone: the same whatever the partitions or the order of rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *keys), 11) / F.lit(float(2**52)) - 1


def next_period(lines: DataFrame, at: str = "invoice_date") -> DataFrame:
    """The month after the newest row's, as yyyy-MM."""
    return lines.agg(F.date_format(F.add_months(F.max(at), 1), "yyyy-MM").alias("period"))


def continued(lines: DataFrame, seed: int, keys: tuple[str, ...] = ("invoice_id", "line_no"), at: str = "invoice_date", ingested: str = "_ingested_at") -> DataFrame:
    """The newest month's invoice lines one month on. Recurring ones stay as they are; others move by a few percent.

    add_months keeps to the end of shorter months. Amounts follow quantity and price, the discount stays a rate.
    """
    month = F.date_trunc("month", F.col(at))
    newest = lines.agg(F.max(month).alias("_newest"))
    last = lines.crossJoin(F.broadcast(newest)).where(month == F.col("_newest")).drop("_newest")  # one row
    usage = F.col("is_recurring") == 0
    qty = F.when(usage, F.greatest(F.lit(1), F.round(F.col("qty") * (1 + QUANTITY * _noise(seed, "qty", *keys))))).otherwise(F.col("qty")).cast("long")
    price = F.when(usage, F.round(F.col("unit_price") * (1 + PRICE * _noise(seed, "price", *keys)), 2)).otherwise(F.col("unit_price"))
    rate = F.coalesce(F.try_divide("discount", F.nullif("amount_gross", F.lit(0.0))), F.lit(0.0))
    out = last.withColumn("_rate", rate).withColumn("qty", qty).withColumn("unit_price", price)
    out = out.withColumn("amount_gross", F.round(F.col("qty") * F.col("unit_price"), 2)).withColumn("discount", F.round(F.col("amount_gross") * F.col("_rate"), 2))
    out = out.withColumn("amount_net", F.round(F.col("amount_gross") - F.col("discount"), 2)).withColumn(at, F.add_months(at, 1))
    return out.withColumn(ingested, F.col(at).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).withColumn(keys[0], F.concat(F.col(keys[0]), F.lit("-"), F.date_format(at, "yyyyMM"))).drop("_rate")


def resynced(rows: DataFrame, column: str, as_of: Column) -> DataFrame:
    return rows.withColumn(column, as_of.cast("timestamp_ntz"))


def next_batch(model: Model, seed: int) -> tuple[str, Model]:
    """The month after the newest one of invoice_line, and the model with its rows: lines one month on and, if the model has
    invoices, those of the newest month one month on with the sums of their lines, 0 without any.

    Only the new rows are written. A model without a line to continue is an error.
    """
    lines, heads = model.facts.get("invoice_line"), model.facts.get("invoice")
    period = lines and next_period(lines.df, lines.period).first().period
    if not period:
        raise ValueError("no invoice_line to continue")
    more = settled(continued(lines.df, seed, at=lines.period))
    facts = dict(model.facts) | {"invoice_line": dataclasses.replace(lines, df=lines.df.unionByName(more))}
    if heads:
        at = heads.period
        moved = heads.df.withColumn(at, F.add_months(at, 1)).where(F.date_format(at, "yyyy-MM") == period)
        moved = moved.withColumn("invoice_id", F.concat("invoice_id", F.lit("-"), F.date_format(at, "yyyyMM"))).withColumn("_ingested_at", F.col(at).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
        sums = more.groupBy("invoice_id").agg(*(F.round(F.sum(c), 2).alias(f"_{c}") for c in ("amount_gross", "amount_net")))
        moved = moved.join(sums, "invoice_id", "left").withColumns({c: F.coalesce(f"_{c}", F.lit(0.0)) for c in ("amount_gross", "amount_net")})
        facts["invoice"] = dataclasses.replace(heads, df=heads.df.unionByName(settled(moved.select(*heads.df.columns))))
    return period, dataclasses.replace(model, facts=facts)

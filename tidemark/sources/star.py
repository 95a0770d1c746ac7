"""The engine's model over a star of Parquet tables: sales lines with their orders, customers as accounts, events as tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.contract import Contract, contract_of
from tidemark.plans.panel import Fact, Model

#: The period that investigations of the test tables look at, and the end of the history.
CURRENT, FIRST = "2001-07", "1995-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """account_id, region, segment. Region and nation are small, so their joins become broadcasts by their size."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("r_name").alias("region"))
    customer = table(spark, folder, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(F.col("c_custkey").alias("account_id"), "region", F.col("c_mktsegment").alias("segment"))


def regions_of(spark: SparkSession, folder: str) -> DataFrame:
    """The regions that have accounts."""
    return accounts(spark, folder).select("region").distinct()


def sales(spark: SparkSession, folder: str) -> DataFrame:
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = line.join(order, line.l_orderkey == order.o_orderkey)
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("l_partkey").alias("product_id"),
        F.to_date("o_orderdate").alias("sold_on"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("amount_gross"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_net"),
        (F.col("l_linestatus") == "F").cast("int").alias("is_recurring"),
        F.to_date("l_shipdate").alias("ingested_on"),
        F.col("l_returnflag").alias("return_flag"),
    )


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("ticket_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("category"), "value")


def model(spark: SparkSession, folder: str) -> Model:
    """sales; refunds, the lines sent back; tickets."""
    lines = sales(spark, folder)
    refunds = lines.where("return_flag = 'R'").select("account_id", "product_id", F.col("sold_on").alias("refunded_on"), F.col("amount_net").alias("amount"), "ingested_on")
    return Model({"sales": Fact(lines, "sold_on", "ingested_on"), "refunds": Fact(refunds, "refunded_on", "ingested_on"), "tickets": Fact(tickets(spark, folder), "created_at", "created_at")}, accounts(spark, folder))


def _contract(**raw) -> Contract:
    return contract_of({"materiality": {"relative": 0.03, "absolute": 1000.0}, "dimensions": ["region", "segment"]} | raw)


#: Contracts of the test tables: each form of the metric language once.
CONTRACTS = {
    c.id: c
    for c in (
        _contract(id="gross_sales", formula="SUM(sales.amount_gross)"),
        _contract(id="net_sales", formula="SUM(sales.amount_net) - SUM(refunds.amount)"),
        _contract(id="discount_rate", formula="SUM(sales.discount) / SUM(sales.amount_gross)", filters=["sales.qty <> 1"]),
        _contract(id="median_price", formula="MEDIAN(sales.amount_gross) / 60.0", filters=["sales.return_flag = 'N'"]),
        _contract(id="mean_quantity", formula="AVG(sales.qty)"),
        _contract(id="kept_share", formula="(SUM(sales.amount_net) - SUM(refunds.amount)) / SUM(sales.amount_net)"),
        _contract(id="line_count", formula="COUNT(sales.order_id)", filters=["sales.account_id NOT IN (SELECT account_id FROM accounts_excluded)"]),
        _contract(
            id="net_sales_redefined",
            formula="SUM(sales.amount_net) - SUM(refunds.amount)",
            history_start="1995-01-01",
            epochs=[
                {"effective_from": "1995-01-01", "formula": "SUM(sales.amount_gross)"},
                {"effective_from": "1998-01-01", "formula": "SUM(sales.amount_gross) - SUM(refunds.amount)"},
                {"effective_from": "2000-01-01", "formula": "SUM(sales.amount_net) - SUM(refunds.amount)"},
            ],
        ),
    )
}

"""Named queries over the star of test tables, one an operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common parts of the SQL.
SALES = """sales AS (
  SELECT o_orderkey AS order_id, o_custkey AS account_id, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS sold_on,
         strftime(o_orderdate, '%Y-%m') AS period, l_quantity AS qty, l_extendedprice AS amount_gross, l_extendedprice * l_discount AS discount,
         l_extendedprice * (1 - l_discount) AS amount_net, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_recurring,
         CAST(l_shipdate AS DATE) AS ingested_on, l_returnflag AS return_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ACCOUNT = """account AS (
  SELECT c_custkey AS account_id, r_name AS region, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def month_before(value: str) -> str:
    """SQL of a value in the month before, of panels by region and period; null where that month has no row."""
    w = "OVER (PARTITION BY region ORDER BY period)"
    return f"CASE WHEN lag(period) {w} = strftime(CAST(period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') THEN lag({value}) {w} END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _part in ("metric", "series", "verify", "decompose", "evidence", "outcome", "swept"):
    import_module(f"tidemark.queries.{_part}")

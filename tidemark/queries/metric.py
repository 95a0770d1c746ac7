"""Metric language, conformance, calendar and watermarks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions.columns import minutes_crossed
from tidemark.operators.conform import conform_field, conform_keys, fiscal_calendar, flag_tests, watermarks
from tidemark.operators.scan import closed_period
from tidemark.plans.panel import Model, kpi_panel, with_spine
from tidemark.queries import ACCOUNT, SALES, query
from tidemark.sources.star import CONTRACTS, CURRENT, FIRST, accounts, model, sales, table, tickets

R4 = lambda c: F.round(c, 4)  # noqa: E731  amounts have four decimals: a sum rounded there doesn't depend on its order


@query("kpi_sum_by_region_month", f"WITH {SALES}, {ACCOUNT} SELECT period, region, round(sum(amount_gross), 4) AS value FROM sales JOIN account USING (account_id) GROUP BY 1, 2")
def kpi_sum(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["gross_sales"], ["region"]).select("period", "region", R4("value").alias("value"))


@query(
    "kpi_two_term_net",
    f"""WITH {SALES}, {ACCOUNT} SELECT period, region, round(sum(amount_net) - coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0), 4) AS value
        FROM sales JOIN account USING (account_id) GROUP BY 1, 2""",
)
def kpi_net(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["net_sales"], ["region"]).select("period", "region", R4("value").alias("value"))


@query(
    "kpi_ratio_month",
    f"""WITH {SALES} SELECT period, round(sum(discount), 4) AS num, round(sum(amount_gross), 4) AS den, round(sum(discount) / nullif(sum(amount_gross), 0), 9) AS value
        FROM sales WHERE qty <> 1 GROUP BY 1""",
)
def kpi_ratio(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["discount_rate"]).select("period", R4("num").alias("num"), R4("den").alias("den"), F.round("value", 9).alias("value"))


@query("kpi_median_month", f"WITH {SALES} SELECT period, round(median(amount_gross) / 60.0, 9) AS value FROM sales WHERE return_flag = 'N' GROUP BY 1")
def kpi_median(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["median_price"]).select("period", F.round("value", 9).alias("value"))


@query("kpi_avg_by_segment_month", f"WITH {SALES}, {ACCOUNT} SELECT period, segment, round(avg(qty), 9) AS value FROM sales JOIN account USING (account_id) GROUP BY 1, 2")
def kpi_avg(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["mean_quantity"], ["segment"]).select("period", "segment", F.round("value", 9).alias("value"))


@query(
    "kpi_compound_ratio",
    f"""WITH {SALES}, {ACCOUNT} SELECT period, region, segment, round((sum(amount_net) - coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0)) / nullif(sum(amount_net), 0), 9) AS value
        FROM sales JOIN account USING (account_id) GROUP BY 1, 2, 3""",
)
def kpi_compound(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["kept_share"], ["region", "segment"]).select("period", "region", "segment", F.round("value", 9).alias("value"))


@query("kpi_count_filtered", f"WITH {SALES} SELECT period, CAST(count(order_id) AS DOUBLE) AS value FROM sales WHERE account_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def kpi_count(spark, d):
    m = model(spark, d)
    excluded = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("account_id"))
    return kpi_panel(Model(m.facts, m.accounts, views={"accounts_excluded": excluded}), CONTRACTS["line_count"]).select("period", "value")


@query(
    "kpi_epoch_switch",
    f"""WITH {SALES}, {ACCOUNT}, t AS (SELECT period, region, sum(amount_gross) AS g, sum(amount_net) AS n, coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0) AS r
          FROM sales JOIN account USING (account_id) GROUP BY 1, 2)
        SELECT period, region, round(CASE WHEN period < '1998-01' THEN g WHEN period < '2000-01' THEN g - r ELSE n - r END, 4) AS value FROM t""",
)
def kpi_epochs(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["net_sales_redefined"], ["region"]).select("period", "region", R4("value").alias("value"))


@query(
    "kpi_month_spine",
    f"""WITH {SALES}, {ACCOUNT}, t AS (SELECT period, region, segment, sum(amount_gross) AS v FROM sales JOIN account USING (account_id) WHERE return_flag = 'R' GROUP BY 1, 2, 3),
        m AS (SELECT strftime(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)), '%Y-%m') AS period), s AS (SELECT DISTINCT region, segment FROM t)
        SELECT m.period, s.region, s.segment, round(coalesce(v, 0), 4) AS value FROM m CROSS JOIN s LEFT JOIN t ON t.period = m.period AND t.region = s.region AND t.segment = s.segment""",
)
def kpi_spine(spark, d):
    import dataclasses

    c = dataclasses.replace(CONTRACTS["gross_sales"], filters=("sales.return_flag = 'R'",))
    return with_spine(kpi_panel(model(spark, d), c, ["region", "segment"]), ["region", "segment"], FIRST, "2001-08", 0.0).select("period", "region", "segment", R4("value").alias("value"))


_CALENDAR = """SELECT CAST(day AS DATE) AS day, date_diff('day', DATE '1994-03-28', CAST(day AS DATE)) AS n FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS day)"""
_FISCAL = f"""c AS (SELECT day, floor(n / 7) AS w, floor(floor(n / 7) / 52) AS y FROM ({_CALENDAR})), f AS (SELECT day, y, CAST(w - 52 * y AS INTEGER) AS iw FROM c),
  fiscal AS (SELECT day, CAST(y + 1995 AS INTEGER) AS fiscal_year, CAST(iw // 13 + 1 AS INTEGER) AS fiscal_quarter,
    CAST((iw // 13) * 3 + CASE WHEN iw % 13 < 4 THEN 0 WHEN iw % 13 < 8 THEN 1 ELSE 2 END + 1 AS INTEGER) AS fiscal_period, CAST(iw + 1 AS INTEGER) AS fiscal_week FROM f)"""


def _calendar(spark):
    return fiscal_calendar(spark, date(1994, 1, 1), date(2002, 12, 31), date(1994, 3, 28))


@query("fiscal_445_calendar", f"WITH {_FISCAL} SELECT strftime(day, '%Y-%m-%d') AS day, fiscal_year, fiscal_quarter, fiscal_period, fiscal_week, 'FY' || fiscal_year || '-P' || lpad(CAST(fiscal_period AS VARCHAR), 2, '0') AS period_label, count(*) AS n_orders FROM fiscal JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY ALL")
def calendar(spark, d):
    """Each day that has orders in the calendar, with their number."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    return _calendar(spark).join(days, "day").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "kpi_fiscal_period",
    f"""WITH {SALES}, {_FISCAL} SELECT 'FY' || fiscal_year || '-P' || lpad(CAST(fiscal_period AS VARCHAR), 2, '0') AS period, round(sum(amount_gross), 4) AS value
        FROM sales JOIN fiscal ON sold_on = day GROUP BY 1""",
)
def kpi_fiscal(spark, d):
    m = model(spark, d)
    return kpi_panel(Model(m.facts, m.accounts, _calendar(spark)), CONTRACTS["gross_sales"], fiscal=True).select("period", R4("value").alias("value"))


@query(
    "watermark_per_source",
    """SELECT source, max(w) AS watermark, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT 'billing' AS source, max(l_shipdate) AS w, count(*) AS n FROM lineitem
       UNION ALL SELECT 'billing', max(o_orderdate), count(*) FROM orders UNION ALL SELECT 'product_ops', max(ts), count(*) FROM events) GROUP BY 1""",
)
def marks(spark, d):
    t = lambda n: table(spark, d, n)
    return watermarks({"lineitem": ("billing", t("lineitem"), "l_shipdate"), "orders": ("billing", t("orders"), "o_orderdate"), "events": ("product_ops", t("events"), "ts"), "customer": ("crm", t("customer"), None)})


@query(
    "latest_closed_period",
    """SELECT 'orders' AS name, strftime(CASE WHEN CAST(w AS DATE) >= last_day(w) THEN w ELSE w - INTERVAL 1 MONTH END, '%Y-%m') AS period FROM (SELECT max(o_orderdate) AS w FROM orders)
       UNION ALL SELECT 'events', strftime(CASE WHEN CAST(w AS DATE) >= last_day(w) THEN w ELSE w - INTERVAL 1 MONTH END, '%Y-%m') FROM (SELECT max(ts) AS w FROM events)""",
)
def closed(spark, d):
    one = lambda name, c: table(spark, d, name).agg(F.max(c).alias("w")).select(F.lit(name).alias("name"), closed_period(F.col("w")).alias("period"))
    return one("orders", "o_orderdate").unionByName(one("events", "ts"))


_ALIAS = "alias AS (SELECT 'B-' || c_custkey AS raw_id, c_custkey AS account_id FROM customer)"


@query(
    "conform_account_keys",
    f"WITH {_ALIAS} SELECT account_id, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM (SELECT 'B-' || o_custkey AS raw_id, o_totalprice FROM orders) JOIN alias USING (raw_id) GROUP BY 1",
)
def keys(spark, d):
    alias = table(spark, d, "customer").select(F.lit("billing").alias("source"), F.concat(F.lit("B-"), F.col("c_custkey").cast("string")).alias("raw_id"), F.col("c_custkey").alias("account_id"))
    raw = table(spark, d, "orders").select(F.concat(F.lit("B-"), F.col("o_custkey").cast("string")).alias("account_id"), "o_totalprice")
    return conform_keys(raw, alias, "billing").groupBy("account_id").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query(
    "conform_region_override",
    f"""WITH {ACCOUNT}, raw AS (SELECT o_orderkey, o_custkey AS account_id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ASIA' ELSE r END AS region
          FROM orders JOIN (SELECT account_id AS k, region AS r FROM account) ON o_custkey = k)
        SELECT a.region, count(*) AS n, count(*) FILTER (WHERE raw.region IS DISTINCT FROM a.region) AS overridden FROM raw JOIN account a USING (account_id) GROUP BY 1""",
)
def override(spark, d):
    a, o = accounts(spark, d), table(spark, d, "orders")
    raw = o.join(a, o.o_custkey == a.account_id).select("account_id", F.when(F.col("o_orderkey") % 7 == 1, "ASIA").when(F.col("o_orderkey") % 7 != 0, F.col("region")).alias("region"))
    return conform_field(raw, a, "account_id", "region").groupBy("region").agg(F.count("*").alias("n"), F.count_if("overridden").alias("overridden"))


@query("exclude_test_accounts", f"WITH {ACCOUNT} SELECT region, account_id % 97 = 0 AS is_test, count(*) AS n FROM account GROUP BY 1, 2")
def tests(spark, d):
    a = accounts(spark, d)
    return flag_tests(a, a.where("account_id % 97 = 0")).groupBy("region", "is_test").agg(F.count("*").alias("n"))


@query("minutes_between", "SELECT event_type, CAST(sum(date_diff('minute', ts, ts + to_seconds(CAST(floor(value * 10) AS BIGINT)))) AS BIGINT) AS minutes FROM events GROUP BY 1")
def minutes(spark, d):
    e = table(spark, d, "events")
    end = F.timestamp_add("SECOND", F.floor(F.col("value") * 10), F.col("ts"))
    return e.groupBy("event_type").agg(F.sum(minutes_crossed(F.col("ts"), end)).alias("minutes"))


@query("tickets_by_account", "SELECT user_id AS account_id, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def by_account(spark, d):
    return tickets(spark, d).groupBy("account_id", "category").agg(F.count("*").alias("n"))


@query("orphan_lines", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orphans(spark, d):
    line, order = table(spark, d, "lineitem"), table(spark, d, "orders")
    return line.join(order, line.l_orderkey == order.o_orderkey, "left_anti").agg(F.count("*").alias("n"))


@query("current_period_lines", f"WITH {SALES} SELECT count(*) AS n, round(sum(amount_net), 4) AS net FROM sales WHERE sold_on BETWEEN DATE '2001-07-01' AND DATE '2001-07-31'")
def current(spark, d):
    return sales(spark, d).where(F.col("sold_on").between(F.lit(f"{CURRENT}-01").cast("date"), F.last_day(F.lit(f"{CURRENT}-01").cast("date")))).agg(F.count("*").alias("n"), F.round(F.sum("amount_net"), 4).alias("net"))

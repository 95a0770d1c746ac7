"""Checks of whether movements are real, and the sweep over slices."""

from __future__ import annotations

import dataclasses
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators.conform import watermarks
from tidemark.operators.kept import KeptPanel
from tidemark.operators.scan import regions, summary, sweep
from tidemark.operators.series import movement
from tidemark.operators.verify import artefacts, completeness, drift, freshness, records, sparse, verify
from tidemark.plans.panel import kpi_panel
from tidemark.queries import ACCOUNT, SALES, month_before, query
from tidemark.sources.scratch import scratch
from tidemark.sources.star import CONTRACTS, CURRENT, FIRST, accounts, model, table

AS_OF = datetime(2001, 12, 1)


def _marks(spark, d):
    return watermarks({"lineitem": ("billing", table(spark, d, "lineitem"), "l_shipdate"), "orders": ("billing", table(spark, d, "orders"), "o_orderdate"), "events": ("product_ops", table(spark, d, "events"), "ts")}, AS_OF)


@query(
    "freshness_hours",
    """SELECT source, round(date_diff('second', max(w), TIMESTAMP '2001-12-01') / 3600.0, 6) AS hours, date_diff('second', max(w), TIMESTAMP '2001-12-01') / 3600.0 <= 26 AS fresh
       FROM (SELECT 'billing' AS source, max(l_shipdate) AS w FROM lineitem UNION ALL SELECT 'billing', max(o_orderdate) FROM orders UNION ALL SELECT 'product_ops', max(ts) FROM events) GROUP BY 1""",
)
def hours(spark, d):
    return freshness(_marks(spark, d), 26.0).select("source", F.round("hours", 6).alias("hours"), "fresh")


_LATE = "last_day(sold_on) + INTERVAL 48 HOUR"


@query(
    "completeness_share",
    f"""WITH {SALES}, r AS (SELECT period, ingested_on <= {_LATE} AS ok FROM sales UNION ALL SELECT period, ingested_on <= {_LATE} FROM sales WHERE return_flag = 'R')
        SELECT period, count(*) AS n_rows, count(*) FILTER (WHERE ok) AS on_time, round(count(*) FILTER (WHERE ok) / count(*), 9) AS share FROM r GROUP BY 1""",
)
def complete(spark, d):
    return completeness(model(spark, d), CONTRACTS["net_sales"]).select("period", "n_rows", "on_time", F.round("share", 9).alias("share"))


_RECORDS = f"""{SALES}, {ACCOUNT}, x AS (SELECT period, region, amount_net AS v, sold_on, ingested_on FROM sales JOIN account USING (account_id)
    UNION ALL SELECT period, region, amount_net, sold_on, ingested_on FROM sales JOIN account USING (account_id) WHERE return_flag = 'R'),
  rec AS (SELECT period, region, max(abs(v)) AS largest, coalesce(sum(abs(v)) FILTER (WHERE ingested_on < date_trunc('month', sold_on) OR ingested_on > last_day(sold_on) + INTERVAL 2 DAY), 0) AS slipped FROM x GROUP BY 1, 2)"""


@query("largest_record_share", f"WITH {_RECORDS} SELECT period, region, round(largest, 4) AS largest FROM rec")
def largest(spark, d):
    return records(model(spark, d), CONTRACTS["net_sales"], ["region"]).select("period", "region", F.round("largest", 4).alias("largest"))


@query("slippage_value", f"WITH {_RECORDS} SELECT period, region, round(slipped, 4) AS slipped FROM rec")
def slipped(spark, d):
    return records(model(spark, d), CONTRACTS["net_sales"], ["region"]).select("period", "region", F.round("slipped", 4).alias("slipped"))


@query(
    "artefact_check",
    f"""WITH {_RECORDS}, p AS (SELECT period, region, sum(amount_net) - coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0) AS value FROM sales JOIN account USING (account_id) GROUP BY 1, 2),
        m AS (SELECT period, region, value - {month_before('value')} AS delta FROM p),
        t AS (SELECT period, region, greatest(largest, coalesce({month_before('largest')}, 0)) AS largest, slipped FROM rec)
        SELECT period, region, round(largest / nullif(abs(delta), 0), 6) AS record_share, greatest(coalesce(largest / nullif(abs(delta), 0), 0), coalesce(slipped / nullif(abs(delta), 0), 0)) > 0.35 AS artefact
        FROM m JOIN t USING (period, region)""",
)
def artefact(spark, d):
    m, c = model(spark, d), CONTRACTS["net_sales"]
    out = artefacts(movement(kpi_panel(m, c, ["region"]), ["region"]), records(m, c, ["region"]), ["region"], 0.35)
    return out.select("period", "region", F.round("record_share", 6).alias("record_share"), "artefact")


@query(
    "definition_drift",
    f"""WITH {SALES}, {ACCOUNT}, t AS (SELECT period, region, sum(amount_gross) AS g, coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0) AS r FROM sales JOIN account USING (account_id) GROUP BY 1, 2),
        v AS (SELECT period, region, g, {month_before('g')} AS g0, g - r AS h, {month_before('g - r')} AS h0 FROM t)
        SELECT period, region, round(CASE period WHEN '1998-01' THEN (g - g0) / g0 ELSE (h - h0) / h0 END, 9) AS earlier_relative, abs(CASE period WHEN '1998-01' THEN (g - g0) / g0 ELSE (h - h0) / h0 END) < 0.03 AS drifted
        FROM v WHERE period IN ('1998-01', '2000-01')""",
)
def drifted(spark, d):
    return drift(model(spark, d), CONTRACTS["net_sales_redefined"], ["region"]).select("period", "region", F.round("earlier_relative", 9).alias("earlier_relative"), "drifted")


@query("verify_all_slices")
def everything(spark, d):
    """All checks of all regions in one frame; it has the seasonal decomposition in it, so no SQL."""
    out = verify(model(spark, d), CONTRACTS["net_sales"], ["region"], CURRENT, FIRST, _marks(spark, d), AS_OF)
    return out.select("region", F.round("value", 4).alias("value"), F.round("delta", 4).alias("delta"), "complete", "drifted", "artefact", "material", "passed", "ceiling")


def _swept(spark, d):
    m = dataclasses.replace(model(spark, d), views={"accounts_excluded": accounts(spark, d).where("segment = 'MACHINERY'").select("account_id")})
    return sweep(m, [*CONTRACTS.values()], CURRENT, FIRST)


@query("scan_status")
def scan(spark, d):
    """The sweep of all contracts over all regions, with a status for each slice."""
    return _swept(spark, d).select("case_id", "kpi", "period", "region", F.round("delta", 6).alias("delta"), "status")


@query("scan_summary")
def totals(spark, d):
    return summary(_swept(spark, d))


@query(
    "sparse_baseline",
    f"""WITH {SALES}, {ACCOUNT}, p AS (SELECT region, period, sum(amount_gross) AS v FROM sales JOIN account USING (account_id) WHERE period IN ('2001-06', '{CURRENT}') GROUP BY 1, 2),
        m AS (SELECT region, sum(v) FILTER (WHERE period = '{CURRENT}') AS v1, sum(v) FILTER (WHERE period <> '{CURRENT}') AS v0 FROM p GROUP BY 1), r AS (SELECT *, (v1 - v0) / v0 AS rel FROM m),
        e AS (SELECT a.region, any_value(a.v0) * (1 + median(b.rel)) AS expected, any_value(a.v1) AS v1, any_value(a.v1 - a.v0) AS delta FROM r a JOIN r b ON a.region <> b.region GROUP BY 1)
        SELECT region, round(expected, 4) AS expected, round((v1 - expected) / expected, 8) AS surprise, abs((v1 - expected) / expected) >= 0.03 AND abs(delta) >= 1000 AS material, 'likely' AS ceiling FROM e""",
)
def young(spark, d):
    """A contract whose history is a day short of two seasons takes its baseline from peers; one of exactly two doesn't."""
    c = dataclasses.replace(CONTRACTS["gross_sales"], id="young_sales", history_start=date(1999, 8, 2))
    assert sparse(c, CURRENT) and not sparse(dataclasses.replace(c, history_start=date(1999, 8, 1)), CURRENT)
    out = verify(model(spark, d), c, ["region"], CURRENT, FIRST)
    return out.select("region", F.round("expected", 4).alias("expected"), F.round("surprise", 8).alias("surprise"), "material", "ceiling")


@query("regions_listed", "SELECT DISTINCT r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def listed(spark, d):
    return regions(accounts(spark, d))


_LATE = "(ingested_on < date_trunc('month', sold_on) OR ingested_on > last_day(sold_on) + 2)"


@query(
    "late_batch_upgrade",
    f"""WITH {SALES}, {ACCOUNT}, s AS (SELECT * FROM sales JOIN account USING (account_id))
        SELECT 'net_sales' AS kpi, period, region, round(sum(amount_net) - coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0), 4) AS value, round(max(amount_net), 4) AS largest,
               round(coalesce(sum(amount_net) FILTER (WHERE {_LATE}), 0) + coalesce(sum(amount_net) FILTER (WHERE {_LATE} AND return_flag = 'R'), 0), 4) AS slipped FROM s GROUP BY ALL
        UNION ALL SELECT 'discount_rate', period, region, round(sum(discount) / sum(amount_gross), 4), NULL, NULL FROM s WHERE qty <> 1 GROUP BY ALL
        UNION ALL SELECT 'mean_quantity', period, region, round(avg(qty), 4), NULL, NULL FROM s GROUP BY ALL""",
)
def kept(spark, d):
    """A panel kept from two batches, of which the second is late for most months and the first came twice, is that of all rows."""
    m, contracts = model(spark, d), [CONTRACTS[n] for n in ("net_sales", "discount_rate", "mean_quantity")]
    panel = KeptPanel(spark, scratch(spark), contracts, ["region"])
    for version, when in ((1, "ingested_on <= '1998-06-30'"), (2, "ingested_on > '1998-06-30'"), (1, "ingested_on <= '1998-06-30'")):
        for name in ("sales", "refunds"):
            panel.add(m, name, m.facts[name].df.where(when), version)
    out = panel.gathered(m, "1990-01", "2010-12").panels(contracts)
    return out.select("kpi", "period", "region", *(F.round(c, 4).alias(c) for c in ("value", "largest", "slipped")))

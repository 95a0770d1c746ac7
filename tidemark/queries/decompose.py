"""Where a movement comes from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.decompose import concentration, contributions, covering, display, footprint, partition, pvm, recurring_changes, residual, tree
from tidemark.plans.panel import labelled, scoped
from tidemark.queries import ACCOUNT, SALES, query
from tidemark.sources.star import CONTRACTS, CURRENT, model, sales, tickets

PREVIOUS = "2001-06"
DIMS = ["region", "segment"]

_SIDES = f"""{SALES}, {ACCOUNT}, s AS (SELECT account_id, region, segment, product_id, period, qty, amount_net, amount_gross, discount, return_flag, is_recurring FROM sales JOIN account USING (account_id) WHERE period IN ('{PREVIOUS}', '{CURRENT}'))"""
_V = "amount_net * CASE WHEN return_flag = 'R' THEN 0 ELSE 1 END * CASE WHEN period = '2001-07' THEN 1 ELSE -1 END"
_NODES = f"""{_SIDES}, k AS (SELECT 'region' AS dimension, region AS key, {_V} AS v FROM s UNION ALL SELECT 'segment', segment, {_V} FROM s),
  raw AS (SELECT dimension, key, sum(v) AS delta FROM k GROUP BY 1, 2), nodes AS (SELECT *, delta / sum(delta) OVER (PARTITION BY dimension) AS share FROM raw WHERE delta <> 0)"""


def _nodes(spark, d, dims=DIMS):
    return contributions(model(spark, d), CONTRACTS["net_sales"], dims, CURRENT, PREVIOUS)


@query("contribution_by_dim", f"WITH {_NODES} SELECT dimension, key, round(delta, 4) AS delta, round(share, 7) AS share FROM nodes")
def by_dimension(spark, d):
    return _nodes(spark, d).select("dimension", "key", F.round("delta", 4).alias("delta"), F.round("share", 7).alias("share"))


@query(
    "ratio_contribution",
    f"""WITH {_SIDES}, f AS (SELECT * FROM s WHERE qty <> 1), w AS (SELECT sum(amount_gross) FILTER (WHERE period = '{PREVIOUS}') AS d0, sum(amount_gross) FILTER (WHERE period = '{CURRENT}') AS d1 FROM f)
        SELECT 'region' AS dimension, region AS key, round(coalesce(sum(discount) FILTER (WHERE period = '{CURRENT}'), 0) / any_value(d1) - coalesce(sum(discount) FILTER (WHERE period = '{PREVIOUS}'), 0) / any_value(d0), 9) AS delta FROM f, w GROUP BY 2""",
)
def ratio(spark, d):
    return contributions(model(spark, d), CONTRACTS["discount_rate"], ["region"], CURRENT, PREVIOUS).select("dimension", "key", F.round("delta", 9).alias("delta"))


#: c: the change of each account, and in part what larger ones have of all changes.
COVERED = f"""{_SIDES}, n AS (SELECT account_id, sum({_V}) AS delta FROM s GROUP BY 1 HAVING sum({_V}) <> 0),
  c AS (SELECT *, coalesce(sum(abs(delta)) OVER (ORDER BY abs(delta) DESC, CAST(account_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(delta)) OVER () AS part FROM n)"""


@query("greedy_footprint", f"WITH {COVERED} SELECT CAST(account_id AS VARCHAR) AS key, round(delta, 4) AS delta FROM c WHERE part < 0.8")
def covered(spark, d):
    return footprint(_nodes(spark, d, ["account_id"])).select("key", F.round("delta", 4).alias("delta"))


@query(
    "concentration_hhi",
    f"""WITH {_NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(delta) DESC, key) AS n, sum(delta) OVER (PARTITION BY dimension) AS t FROM nodes)
        SELECT dimension, round(sum(abs(delta)) FILTER (WHERE n <= 2) / sum(abs(delta)), 7) AS top_share, round(sum(pow(delta / t, 2)), 5) AS hhi FROM r GROUP BY 1""",
)
def concentrated(spark, d):
    return concentration(_nodes(spark, d), ["dimension"]).select("dimension", F.round("top_share", 7).alias("top_share"), F.round("hhi", 5).alias("hhi"))


@query(
    "nested_contribution",
    f"""WITH {_NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(delta) DESC, key) AS n FROM nodes),
        o AS (SELECT dimension, row_number() OVER (ORDER BY sum(abs(delta)) FILTER (WHERE n <= 2) / sum(abs(delta)) DESC, dimension) AS place FROM r GROUP BY 1),
        one AS (SELECT CASE WHEN (SELECT dimension FROM o WHERE place = 1) = 'region' THEN region ELSE segment END AS a, CASE WHEN (SELECT dimension FROM o WHERE place = 1) = 'region' THEN segment ELSE region END AS b, {_V} AS v FROM s),
        l1 AS (SELECT a, sum(v) AS delta FROM one GROUP BY 1 HAVING sum(v) <> 0),
        c AS (SELECT *, coalesce(sum(abs(delta)) OVER (ORDER BY abs(delta) DESC, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(delta)) OVER () AS part, delta / sum(delta) OVER () AS share FROM l1),
        l2 AS (SELECT a, b, sum(v) AS delta FROM one GROUP BY 1, 2 HAVING sum(v) <> 0),
        c2 AS (SELECT *, coalesce(sum(abs(delta)) OVER (PARTITION BY a ORDER BY abs(delta) DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(delta)) OVER (PARTITION BY a) AS part FROM l2)
        SELECT a AS path, 1 AS depth, round(delta, 4) AS delta, round(share, 6) AS share FROM c
        UNION ALL SELECT c2.a || '/' || c2.b, 2, round(c2.delta, 4), round(c2.delta / c.delta, 6) FROM c2 JOIN c ON c.a = c2.a AND c.part < 0.8 AND c2.part < 0.8""",
)
def nested(spark, d):
    out = tree(model(spark, d), CONTRACTS["net_sales"], DIMS, CURRENT, PREVIOUS)
    return out.select(F.concat_ws("/", "path").alias("path"), "depth", F.round("delta", 4).alias("delta"), F.round("share", 6).alias("share"))


@query(
    "nested_ratio",
    f"""WITH {_SIDES}, f AS (SELECT * FROM s WHERE qty <> 1), w AS (SELECT sum(amount_gross) FILTER (WHERE period = '{PREVIOUS}') AS d0, sum(amount_gross) FILTER (WHERE period = '{CURRENT}') AS d1 FROM f),
        v AS (SELECT region, segment, CASE WHEN period = '{CURRENT}' THEN discount / d1 ELSE -discount / d0 END AS v FROM f, w),
        nd AS (SELECT 'region' AS dimension, region AS key, sum(v) AS delta FROM v GROUP BY 2 UNION ALL SELECT 'segment', segment, sum(v) FROM v GROUP BY 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(delta) DESC, key) AS n FROM nd),
        o AS (SELECT dimension, row_number() OVER (ORDER BY sum(abs(delta)) FILTER (WHERE n <= 2) / sum(abs(delta)) DESC, dimension) AS place FROM r GROUP BY 1),
        one AS (SELECT CASE WHEN (SELECT dimension FROM o WHERE place = 1) = 'region' THEN region ELSE segment END AS a, CASE WHEN (SELECT dimension FROM o WHERE place = 1) = 'region' THEN segment ELSE region END AS b, v FROM v),
        l1 AS (SELECT a, sum(v) AS delta FROM one GROUP BY 1), l2 AS (SELECT a, b, sum(v) AS delta FROM one GROUP BY 1, 2),
        c AS (SELECT *, coalesce(sum(abs(delta)) OVER (ORDER BY abs(delta) DESC, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(delta)) OVER () AS part, delta / sum(delta) OVER () AS share FROM l1),
        c2 AS (SELECT *, coalesce(sum(abs(delta)) OVER (PARTITION BY a ORDER BY abs(delta) DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(delta)) OVER (PARTITION BY a) AS part FROM l2)
        SELECT a AS path, 1 AS depth, round(delta, 8) AS delta, round(share, 5) AS share FROM c
        UNION ALL SELECT c2.a || '/' || c2.b, 2, round(c2.delta, 8), round(c2.delta / c.delta, 5) FROM c2 JOIN c ON c.a = c2.a AND c.part < 0.8 AND c2.part < 0.8""",
)
def nested_ratio(spark, d):
    out = tree(model(spark, d), CONTRACTS["discount_rate"], DIMS, CURRENT, PREVIOUS)
    return out.select(F.concat_ws("/", "path").alias("path"), "depth", F.round("delta", 8).alias("delta"), F.round("share", 5).alias("share"))


@query(
    "median_contribution",
    f"""WITH {_SIDES}, n AS (SELECT * FROM s WHERE return_flag = 'N'), m AS (SELECT coalesce(median(amount_gross) FILTER (WHERE period = '{CURRENT}'), 0) / 60 - coalesce(median(amount_gross) FILTER (WHERE period = '{PREVIOUS}'), 0) / 60 AS t FROM n),
        k AS (SELECT 'region' AS dimension, region AS key, period, amount_gross FROM n UNION ALL SELECT 'segment', segment, period, amount_gross FROM n),
        g AS (SELECT dimension, key, coalesce(median(amount_gross) FILTER (WHERE period = '{CURRENT}'), 0) / 60 - coalesce(median(amount_gross) FILTER (WHERE period = '{PREVIOUS}'), 0) / 60 AS delta FROM k GROUP BY 1, 2)
        SELECT dimension, key, round(delta, 7) AS delta, round(delta / nullif(t, 0), 6) AS share FROM g, m WHERE delta <> 0""",
)
def medians(spark, d):
    out = contributions(model(spark, d), CONTRACTS["median_price"], DIMS, CURRENT, PREVIOUS)
    return out.select("dimension", "key", F.round("delta", 7).alias("delta"), F.round("share", 6).alias("share"))


@query(
    "pvm_split",
    f"""WITH {_SIDES}, b AS (SELECT region, account_id, product_id, sum(qty) FILTER (WHERE period = '{PREVIOUS}') AS q0, sum(amount_net) FILTER (WHERE period = '{PREVIOUS}') AS a0,
          sum(qty) FILTER (WHERE period = '{CURRENT}') AS q1, sum(amount_net) FILTER (WHERE period = '{CURRENT}') AS a1 FROM s GROUP BY 1, 2, 3),
        p AS (SELECT region, coalesce(q0, 0) AS q0, coalesce(q1, 0) AS q1, coalesce(a0 / q0, a1 / q1) AS p0, coalesce(a1 / q1, a0 / q0) AS p1 FROM b)
        SELECT region, round(sum((p1 - p0) * q0), 3) AS price, round(sum(p0 * (q1 - q0)), 3) AS volume, round(sum((p1 - p0) * (q1 - q0)), 3) AS mix, round(sum(p1 * q1 - p0 * q0), 3) AS total FROM p GROUP BY 1""",
)
def split(spark, d):
    return pvm(model(spark, d), "sales", ["region"], CURRENT, PREVIOUS).select("region", *(F.round(c, 3).alias(c) for c in ("price", "volume", "mix", "total")))


def _owners(spark, d):
    t, lines = tickets(spark, d), sales(spark, d)
    first = lines.groupBy("account_id").agg(F.min("sold_on").alias("f"))
    return [
        ("churned", t.where("category = 'error' AND value > 60").select("account_id")),
        ("launched", first.where("f >= DATE '1996-01-01'").select("account_id")),
        ("expanded", t.where("category = 'purchase'").select("account_id")),
    ]


_BUCKETS = f"""{_SIDES}, ch AS (SELECT account_id, sum(CASE WHEN is_recurring = 1 THEN amount_net * CASE WHEN period = '{CURRENT}' THEN 1 ELSE -1 END END) AS rec, sum(CASE WHEN is_recurring = 0 THEN amount_net * CASE WHEN period = '{CURRENT}' THEN 1 ELSE -1 END END) AS oth FROM s GROUP BY 1),
        churned AS (SELECT DISTINCT user_id AS a FROM events WHERE event_type = 'error' AND value > 60), launched AS (SELECT account_id AS a FROM sales GROUP BY 1 HAVING min(sold_on) >= DATE '1996-01-01'), expanded AS (SELECT DISTINCT user_id AS a FROM events WHERE event_type = 'purchase'),
        e AS (SELECT CASE WHEN account_id IN (SELECT a FROM churned) THEN 'churned' WHEN account_id IN (SELECT a FROM launched) THEN 'launched' WHEN account_id IN (SELECT a FROM expanded) THEN 'expanded' ELSE 'non_recurring' END AS bucket, coalesce(rec, 0) AS v FROM ch
              UNION ALL SELECT 'non_recurring', coalesce(oth, 0) FROM ch)"""


@query("cross_kpi_partition", f"WITH {_BUCKETS} SELECT bucket, round(sum(v), 4) AS delta FROM e GROUP BY 1")
def buckets(spark, d):
    changes = recurring_changes(labelled(scoped(model(spark, d), "sales", [], [], months=(PREVIOUS, CURRENT))), CURRENT, PREVIOUS)
    return partition(changes, _owners(spark, d)).select("bucket", F.round("delta", 4).alias("delta"))


@query(
    "contribution_display",
    f"""WITH {_SIDES}, n AS (SELECT account_id AS k, sum({_V}) AS delta FROM s GROUP BY 1 HAVING sum({_V}) <> 0), h AS (SELECT CAST(k AS VARCHAR) AS key, delta / sum(delta) OVER () AS share FROM n),
        r AS (SELECT *, row_number() OVER (ORDER BY abs(share) DESC, key) AS p FROM h)
        SELECT 'account_id' AS dimension, key, round(abs(share), 5) AS share, 1 AS n_keys FROM r WHERE p <= 8 UNION ALL SELECT 'account_id', 'others', round(sum(abs(share)), 4), count(*) FROM r WHERE p > 8""",
)
def shown(spark, d):
    out = display(_nodes(spark, d, ["account_id"]))
    return out.select("dimension", "key", F.when(F.col("key") == "others", F.round("share", 4)).otherwise(F.round("share", 5)).alias("share"), "n_keys")


@query("partition_residual", f"WITH {_BUCKETS}, r AS (SELECT abs(sum(v) - sum(v) FILTER (WHERE bucket <> 'non_recurring')) / nullif(abs(sum(v)), 0) AS residual FROM e) SELECT round(residual, 6) AS residual, residual <= 0.02 AS within FROM r")
def unexplained(spark, d):
    """What the buckets of recurring changes leave of the whole movement."""
    lines = labelled(scoped(model(spark, d), "sales", [], [], months=(PREVIOUS, CURRENT)))
    nodes = partition(recurring_changes(lines, CURRENT, PREVIOUS), _owners(spark, d)).where("bucket <> 'non_recurring'")
    total = lines.where(F.col("period").isin(CURRENT, PREVIOUS)).agg(F.sum(F.when(F.col("period") == CURRENT, F.col("amount_net")).otherwise(-F.col("amount_net")))).first()[0]
    return residual(nodes, total).select(F.round("residual", 6).alias("residual"), "within")


@query("covering_regions", f"WITH {_NODES}, c AS (SELECT *, coalesce(sum(abs(delta)) OVER w, 0) / sum(abs(delta)) OVER (PARTITION BY dimension) AS part FROM nodes WINDOW w AS (PARTITION BY dimension ORDER BY abs(delta) DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT dimension, key FROM c WHERE part < 0.8")
def leading(spark, d):
    return covering(_nodes(spark, d), ["dimension"]).select("dimension", "key")

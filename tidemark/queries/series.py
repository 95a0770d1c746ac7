"""Statistics over panels and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.challenge import control
from tidemark.operators.decompose import pair
from tidemark.operators.bitmaps import bitmaps
from tidemark.operators.bitmaps import overlaps as overlaps_of
from tidemark.operators.ranks import median_selected
from tidemark.operators.series import daily, decomposed, false_alarms, material, movement, onsets, peer_expectation, persistence, placebo, price_volume_mix, robust_z, since_gap, spearman
from tidemark.operators.verify import materiality
from tidemark.plans.contract import Materiality
from tidemark.plans.panel import kpi_panel, with_spine
from tidemark.queries import ACCOUNT, SALES, month_before, query
from tidemark.sources.scratch import settled
from tidemark.sources.star import CONTRACTS, CURRENT, FIRST, accounts, model, sales, table, tickets
from tidemark.streaming.scheduled import windowed_counts

_PANEL = f"""{SALES}, {ACCOUNT}, panel AS (SELECT period, region, sum(amount_net) - coalesce(sum(amount_net) FILTER (WHERE return_flag = 'R'), 0) AS value
  FROM sales JOIN account USING (account_id) WHERE period <= '{CURRENT}' GROUP BY 1, 2)"""
_MOVES = f"""{_PANEL}, moves AS (SELECT *, {month_before('value')} AS previous FROM panel)"""
RULES = Materiality(0.02, 100.0, 1, 1.0)


def _panel(spark, d):
    return kpi_panel(model(spark, d), CONTRACTS["net_sales"], ["region"]).where(F.col("period") <= CURRENT).select("period", "region", "value")


@query("movement_lag", f"WITH {_MOVES} SELECT period, region, round(value, 4) AS value, round(previous, 4) AS previous, round(value - previous, 4) AS delta, round((value - previous) / nullif(previous, 0), 9) AS relative, CASE WHEN previous IS NULL OR previous = 0 THEN 'unverifiable' ELSE 'ok' END AS status FROM moves")
def lagged(spark, d):
    out = movement(_panel(spark, d), ["region"])
    return out.select("period", "region", *(F.round(c, 4).alias(c) for c in ("value", "previous", "delta")), F.round("relative", 9).alias("relative"), "status")


@query(
    "movement_over_gap",
    f"""WITH {_PANEL}, g AS (SELECT *, CAST(period || '-01' AS DATE) AS m FROM panel WHERE period NOT LIKE '%-04')
        SELECT g.period, g.region, round(g.value, 4) AS value, round(b.value, 4) AS previous, CASE WHEN b.value IS NULL OR b.value = 0 THEN 'unverifiable' ELSE 'ok' END AS status FROM g LEFT JOIN g AS b ON b.region = g.region AND b.m = g.m - INTERVAL 1 MONTH""",
)
def lagged_over_gap(spark, d):
    """A month that is missing in the middle leaves the next one unverifiable, not compared with the one before the gap."""
    out = movement(_panel(spark, d).where("period NOT LIKE '%-04'"), ["region"])
    return out.select("period", "region", F.round("value", 4).alias("value"), F.round("previous", 4).alias("previous"), "status")


_Z = f"""{_PANEL}, a AS (SELECT *, value - median(value) OVER (PARTITION BY region) AS r FROM panel), b AS (SELECT *, median(abs(r)) OVER (PARTITION BY region) AS mad, avg(abs(r)) OVER (PARTITION BY region) AS mean FROM a),
  scored AS (SELECT period, region, value, CASE WHEN mad > 0 THEN r / (1.4826 * mad) WHEN mean > 0 THEN r / (1.2533 * mean) ELSE 0 END AS z FROM b)"""


@query("robust_z_panel", f"WITH {_Z} SELECT period, region, round(z, 6) AS z FROM scored")
def scores(spark, d):
    return robust_z(_panel(spark, d), ["region"]).select("period", "region", F.round("z", 6).alias("z"))


_RUN = f"""{_Z}, n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY period DESC) AS k, first(z) OVER (PARTITION BY region ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_z FROM scored),
  runs AS (SELECT region, any_value(last_z) AS last_z, CAST(CASE WHEN abs(any_value(last_z)) > 1.0 THEN coalesce(min(k) FILTER (WHERE NOT (abs(z) > 1.0 AND sign(z) = sign(last_z))) - 1, max(k)) ELSE 0 END AS INTEGER) AS run FROM n GROUP BY 1)"""


@query("persistence_run", f"WITH {_RUN} SELECT region, round(last_z, 6) AS last_z, run FROM runs")
def run(spark, d):
    return persistence(robust_z(_panel(spark, d), ["region"]), ["region"], 1.0).select("region", F.round("last_z", 6).alias("last_z"), "run")


@query(
    "materiality_gate",
    f"""WITH {_RUN}, m AS (SELECT region, value, {month_before('value')} AS previous, period FROM panel),
        g AS (SELECT region, last_z, run, value - previous AS delta, CASE WHEN coalesce(previous, 0) = 0 THEN 0 ELSE abs((value - previous) / previous) END AS rel FROM m JOIN runs USING (region) WHERE period = '{CURRENT}')
        SELECT region, coalesce(abs(last_z) > 1.0, false) AND run >= 1 AND rel >= 0.02 AND coalesce(abs(delta) >= 100, false) AS material,
          concat_ws(',', CASE WHEN NOT coalesce(abs(last_z) > 1.0, false) THEN 'score' END, CASE WHEN run < 1 THEN 'persistence' END, CASE WHEN rel < 0.02 THEN 'relative' END, CASE WHEN NOT coalesce(abs(delta) >= 100, false) THEN 'absolute' END) AS reasons FROM g""",
)
def gate(spark, d):
    panel = _panel(spark, d)
    runs = persistence(robust_z(panel, ["region"]), ["region"], RULES.z_threshold)
    moves = movement(panel, ["region"]).where(F.col("period") == CURRENT)
    return material(moves.join(runs, "region"), RULES).select("region", "material", "reasons")


@query(
    "series_since_gap",
    f"""WITH {SALES}, {ACCOUNT}, p AS (SELECT region, period, CASE WHEN sum(amount_net) FILTER (WHERE return_flag = 'R' AND qty > 49) IS NULL THEN NULL ELSE sum(amount_net) END AS value FROM sales JOIN account USING (account_id) WHERE segment = 'MACHINERY' GROUP BY 1, 2),
        g AS (SELECT *, max(period) FILTER (WHERE value IS NULL) OVER (PARTITION BY region) AS gap FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY period DESC) AS n FROM g WHERE gap IS NULL OR period > gap)
        SELECT region, period, round(value, 4) AS value FROM k WHERE n <= 36""",
)
def gap(spark, d):
    lines = sales(spark, d).join(accounts(spark, d), "account_id").where("segment = 'MACHINERY'")
    some = F.sum(F.when((F.col("return_flag") == "R") & (F.col("qty") > 49), F.col("amount_net")))
    panel = lines.groupBy("region", F.date_format("sold_on", "yyyy-MM").alias("period")).agg(F.when(some.isNotNull(), F.sum("amount_net")).alias("value"))
    return since_gap(panel, ["region"]).select("region", "period", F.round("value", 4).alias("value"))


@query("median_selected", f"WITH {SALES}, {ACCOUNT} SELECT region, period, count(amount_gross) AS n, round(median(amount_gross), 4) AS median FROM sales JOIN account USING (account_id) GROUP BY ALL")
def selected(spark, d):
    """Medians by selection instead of by gathering a group's values."""
    rows = sales(spark, d).join(accounts(spark, d), "account_id").select("region", F.date_format("sold_on", "yyyy-MM").alias("period"), "amount_gross")
    return median_selected(rows, ["region", "period"], "amount_gross").withColumn("median", F.round("median", 4))


@query(
    "peer_expectation",
    f"""WITH {_MOVES}, h AS (SELECT *, (value - previous) / previous AS rel FROM moves WHERE period = '{CURRENT}' AND previous IS NOT NULL AND previous <> 0),
        e AS (SELECT a.region, any_value(a.value) AS value, any_value(a.previous) AS previous, median(b.rel) AS peer FROM h a JOIN h b ON a.region <> b.region GROUP BY 1)
        SELECT region, round(peer, 9) AS peer_move, round(previous * (1 + peer), 4) AS expected, round((value - previous * (1 + peer)) / (previous * (1 + peer)), 9) AS surprise FROM e""",
)
def expectation(spark, d):
    out = peer_expectation(movement(_panel(spark, d), ["region"]), "region", CURRENT, RULES)
    return out.select("region", F.round("peer_move", 9).alias("peer_move"), F.round("expected", 4).alias("expected"), F.round("surprise", 9).alias("surprise"))


@query("stl_decomposition")
def seasonal(spark, d):
    """Trend, season and remainder of each region: sequential smoothing, which SQL can't express; tests pin it down."""
    panel = with_spine(_panel(spark, d), ["region"], FIRST, CURRENT, 0.0)
    return decomposed(panel, ["region"]).select("period", "region", *(F.round(c, 4).alias(c) for c in ("value", "trend", "seasonal", "remainder")))


@query("seasonal_materiality")
def own_baseline(spark, d):
    """Gates on the remainder of the decomposition; without SQL for the reason above."""
    panel = with_spine(_panel(spark, d), ["region"], FIRST, CURRENT, 0.0)
    out = materiality(panel, ["region"], CONTRACTS["net_sales"], CURRENT)
    return out.select("region", F.round("delta", 4).alias("delta"), F.round("last_z", 4).alias("last_z"), "run", "material", "reasons")


_DAYS = """days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day), c AS (SELECT event_type AS category, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"""


@query("dense_daily_series", f"WITH {_DAYS} SELECT category, strftime(d.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM days d CROSS JOIN (SELECT DISTINCT category FROM c) k LEFT JOIN c USING (category, day)")
def dense(spark, d):
    return daily(tickets(spark, d), ["category"], "created_at", "2024-01-01", "2024-01-31").select("category", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("change_points")
def changes(spark, d):
    """Penalised segments of each category's daily counts: a sequential program, pinned down by tests."""
    out = onsets(daily(tickets(spark, d), ["category"], "created_at", "2024-01-01", "2024-01-31"), ["category"])
    return out.select("category", F.concat_ws(",", F.transform("change_points", lambda x: F.date_format(x, "yyyy-MM-dd"))).alias("change_points"), F.date_format("onset", "yyyy-MM-dd").alias("onset"))


@query(
    "jaccard_locality",
    """WITH s AS (SELECT event_type AS category, list(DISTINCT user_id) AS ids FROM events WHERE value > 80 GROUP BY 1)
       SELECT a.category AS a, b.category AS b, round(len(list_intersect(a.ids, b.ids)) / nullif(len(list_distinct(list_concat(a.ids, b.ids))), 0), 9) AS overlap FROM s a JOIN s b ON a.category < b.category""",
)
def overlaps(spark, d):
    sets = settled(bitmaps(tickets(spark, d).where("value > 80"), "category", "account_id"))
    return overlaps_of(sets, sets, "category").where("a < b").select("a", "b", F.round("overlap", 9).alias("overlap"))


@query(
    "spearman_dose",
    f"""WITH {SALES}, {ACCOUNT}, t AS (SELECT account_id, any_value(region) AS region, sum(qty) AS x, count(DISTINCT order_id) AS y FROM sales JOIN account USING (account_id) GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY x) AS px, row_number() OVER (PARTITION BY region ORDER BY y) AS py FROM t),
        m AS (SELECT region, avg(px) OVER (PARTITION BY region, x) AS rx, avg(py) OVER (PARTITION BY region, y) AS ry FROM r)
        SELECT region, count(*) AS n, round(corr(rx, ry), 9) AS rho, CASE WHEN corr(rx, ry) > 0.5 THEN 'pass' WHEN corr(rx, ry) < 0 THEN 'refute' ELSE 'inconclusive' END AS outcome FROM m GROUP BY 1""",
)
def rank_correlation(spark, d):
    t = sales(spark, d).join(accounts(spark, d), "account_id").groupBy("account_id", "region").agg(F.sum("qty").alias("x"), F.count_distinct("order_id").alias("y"))
    return spearman(t, ["region"], "x", "y").withColumn("rho", F.round("rho", 9))


_UNITS = f"""{SALES}, {ACCOUNT}, u AS (SELECT account_id, region, segment, coalesce(sum(amount_net) FILTER (WHERE period <= '1998-06'), 0) AS pre, coalesce(sum(amount_net) FILTER (WHERE period > '1998-06'), 0) AS post
  FROM sales JOIN account USING (account_id) GROUP BY 1, 2, 3)"""
_PLACEBO = """d AS (SELECT *, post - pre AS d FROM p), s AS (SELECT *, count(*) FILTER (WHERE NOT treated) OVER w AS k, sum(d) FILTER (WHERE NOT treated) OVER w AS t, avg(d) FILTER (WHERE treated) OVER w AS m FROM d WINDOW w AS (PARTITION BY g)),
  e AS (SELECT *, m - t / k AS effect, CASE WHEN NOT treated THEN d - (t - d) / nullif(k - 1, 0) END AS pl FROM s),
  q AS (SELECT g, any_value(effect) AS effect, any_value(k) AS controls, count(*) FILTER (WHERE abs(pl) > abs(effect)) + 1 AS rank FROM e GROUP BY 1)"""
_OUTCOME = "CASE WHEN NOT ok THEN 'inconclusive' WHEN rank = 1 THEN 'pass' WHEN rank > (controls + 1) / 2.0 THEN 'refute' ELSE 'inconclusive' END AS outcome"


def _units(spark, d):
    period = F.date_format("sold_on", "yyyy-MM")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_net"))), F.lit(0.0))
    return sales(spark, d).join(accounts(spark, d), "account_id").groupBy("account_id", "region", "segment").agg(part(period <= "1998-06").alias("pre"), part(period > "1998-06").alias("post"))


@query("did_estimate", f"WITH {_UNITS}, p AS (SELECT region AS g, segment = 'BUILDING' AS treated, pre, post FROM u), {_PLACEBO} SELECT g AS region, round(effect, 4) AS effect, controls FROM q")
def difference(spark, d):
    return placebo(_units(spark, d).withColumn("treated", F.col("segment") == "BUILDING"), ["region"]).select("region", F.round("effect", 4).alias("effect"), "controls")


@query(
    "placebo_rank",
    f"WITH {_UNITS}, p AS (SELECT segment AS g, account_id % 10 = 3 AS treated, pre, post FROM u WHERE region = 'ASIA'), {_PLACEBO} SELECT g AS segment, round(effect, 4) AS effect, controls, CASE WHEN ok THEN rank ELSE 0 END AS rank, CASE WHEN ok THEN round(rank / (controls + 1), 9) END AS pseudo_p, {_OUTCOME} FROM (SELECT *, controls >= 5 AND effect IS NOT NULL AS ok FROM q)",
)
def placebos(spark, d):
    out = placebo(_units(spark, d).where("region = 'ASIA'").withColumn("treated", F.col("account_id") % 10 == 3), ["segment"])
    return out.select("segment", F.round("effect", 4).alias("effect"), "controls", F.col("rank").cast("long").alias("rank"), F.round("pseudo_p", 9).alias("pseudo_p"), "outcome")


@query(
    "control_against_peers",
    f"""WITH {_UNITS}, f AS (SELECT account_id, region, segment FROM account WHERE account_id IN (7, 77, 107)), x AS (SELECT DISTINCT region, segment FROM f),
        p AS (SELECT 1 AS g, true AS treated, pre, post FROM u WHERE account_id IN (SELECT account_id FROM f)
              UNION ALL SELECT 1, false, pre, post FROM u JOIN x USING (region, segment) WHERE account_id NOT IN (SELECT account_id FROM f)), {_PLACEBO}
        SELECT round(effect, 4) AS effect, controls, CASE WHEN controls >= 5 AND effect IS NOT NULL THEN rank ELSE 0 END AS rank FROM q""",
)
def peers_control(spark, d):
    a = accounts(spark, d)
    out = control(_units(spark, d).select("account_id", "pre", "post"), a, a.where(F.col("account_id").isin(7, 77, 107)))
    return out.select(F.round("effect", 4).alias("effect"), "controls", F.col("rank").cast("long").alias("rank"))


@query(
    "pvm_two_years",
    f"""WITH {SALES}, {ACCOUNT}, s AS (SELECT region, product_id, sum(qty) FILTER (WHERE period < '1999-01') AS q0, sum(amount_net) FILTER (WHERE period < '1999-01') AS a0,
          sum(qty) FILTER (WHERE period >= '1999-01') AS q1, sum(amount_net) FILTER (WHERE period >= '1999-01') AS a1 FROM sales JOIN account USING (account_id) WHERE period BETWEEN '1998-01' AND '1999-12' GROUP BY 1, 2),
        p AS (SELECT region, coalesce(q0, 0) AS q0, coalesce(q1, 0) AS q1, coalesce(a0 / q0, a1 / q1) AS p0, coalesce(a1 / q1, a0 / q0) AS p1 FROM s)
        SELECT region, round(sum((p1 - p0) * q0), 2) AS price, round(sum(p0 * (q1 - q0)), 2) AS volume, round(sum((p1 - p0) * (q1 - q0)), 2) AS mix FROM p GROUP BY 1""",
)
def two_years(spark, d):
    lines = sales(spark, d).join(accounts(spark, d), "account_id").where("sold_on BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'")
    old = F.year("sold_on") == 1998
    s = lines.groupBy("region", "product_id").agg(*(F.sum(F.when(w, F.col(c))).alias(n) for n, w, c in (("q0", old, "qty"), ("a0", old, "amount_net"), ("q1", ~old, "qty"), ("a1", ~old, "amount_net"))))
    out = price_volume_mix(s.select("region", "q0", (F.col("a0") / F.col("q0")).alias("p0"), "q1", (F.col("a1") / F.col("q1")).alias("p1")), ["region"])
    return out.select("region", *(F.round(c, 2).alias(c) for c in ("price", "volume", "mix")))


@query(
    "event_window_counts",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def windows(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("false_alarm_calibration")
def alarms(spark, d):
    """A simulated stable series for each customer, under a contract's gates: random draws by id, not SQL."""
    return false_alarms(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 36, 0.02, 0.1, Materiality(0.03, 1.0)).select("trials", F.round("rate", 6).alias("rate"))


@query(
    "two_period_pairs",
    f"WITH {SALES}, {ACCOUNT} SELECT region, segment, round(coalesce(sum(amount_gross) FILTER (WHERE period = '2001-06'), 0), 4) AS num0, round(coalesce(sum(amount_gross) FILTER (WHERE period = '2001-07'), 0), 4) AS num1 FROM sales JOIN account USING (account_id) WHERE period IN ('2001-06', '2001-07') GROUP BY 1, 2",
)
def pairs(spark, d):
    return pair(model(spark, d), CONTRACTS["gross_sales"], ["region", "segment"], CURRENT, "2001-06").select("region", "segment", F.round("num0", 4).alias("num0"), F.round("num1", 4).alias("num1"))


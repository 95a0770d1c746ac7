"""Many cases at once: windows of many cases, and the investigation of all their causes."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tidemark.operators.intervals import overlapping, per_day, spike_counts
from tidemark.operators.swept import investigated, windowed
from tidemark.plans.contract import Driver
from tidemark.queries import ACCOUNT, SALES, query
from tidemark.sources.star import CONTRACTS, accounts, model, regions_of, table

PERIODS = ["2001-05", "2001-06", "2001-07"]
KPIS = ["net_sales", "discount_rate"]
_DRIVERS = {"pricing": ("price_delta", 60), "offer": ("lost_reason_scan", 90), "supply": ("incident_scan", 30), "integration": ("ticket_spike", 45)}

_ORDERS = "orders AS o JOIN account ON o_custkey = account_id"
_TABLES = f"""ticket AS (SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'),
  renewal AS (SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS closed FROM orders WHERE o_orderstatus = 'F'),
  book AS (SELECT segment, CAST(o_orderdate AS DATE) AS day FROM {_ORDERS} WHERE o_totalprice > 495000),
  news AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS competitor, region FROM {_ORDERS} WHERE o_totalprice < 3000),
  opp AS (SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'),
  inc AS (SELECT 'I' || o_orderkey AS incident_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 40 AS INTEGER) END AS resolved_at, unnest([o_custkey, o_custkey + 1]) AS account_id FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')"""
_CASES = f"""cases AS (SELECT kpi || '-' || period || '-' || region AS case_id, kpi, period, region, strftime(s, '%Y-%m') AS previous, s AS start_, e AS end_, CAST(s - CAST(date_diff('day', s, e) AS INTEGER) AS DATE) AS baseline
  FROM (SELECT kpi, period, region, CAST(CAST(period || '-01' AS DATE) - INTERVAL 1 MONTH AS DATE) AS s, last_day(CAST(period || '-01' AS DATE)) AS e
        FROM (SELECT unnest({KPIS}) AS kpi), (SELECT unnest({PERIODS}) AS period), (SELECT DISTINCT region FROM account)))"""


def raw_tables(spark, d) -> dict:
    """The star's orders as the raw tables that causes are looked for in."""
    o, a = table(spark, d, "orders"), accounts(spark, d)
    mine = o.join(a, o.o_custkey == a.account_id)
    who, at = F.col("o_custkey").alias("account_id"), F.col("o_orderdate")
    return {
        "account": a,
        "ticket": o.where("o_orderpriority = '1-URGENT'").select(who, at.alias("created_at")),
        "renewal": o.where("o_orderstatus = 'F'").select(who, F.to_date(at).alias("closed_date")),
        "price_book": mine.where("o_totalprice > 495000").select("segment", F.to_date(at).alias("effective_from")),
        "news_item": mine.where("o_totalprice < 3000").select(at.alias("published_at"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("competitor"), "region"),
        "opportunity": o.where("o_orderstatus = 'O'").select(who, F.lit(0).alias("closed_won"), F.to_date(at).alias("close_date"), F.when(F.col("o_orderpriority") == "2-HIGH", "competitor_price").alias("lost_reason_code")),
        "incident": o.where("o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P'").select(
            F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.lit("s").alias("service"), at.alias("started_at"), F.lit("high").alias("severity"),
            F.when(F.col("o_orderkey") % 7 != 0, F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 40 AS INT))")).alias("resolved_at"),
            F.concat_ws("|", F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string")).alias("affected_accounts"),
        ),
    }


def openings(spark, d):
    """All regions of some contracts and periods, as cases."""
    grid = regions_of(spark, d).select("region", F.explode(F.array(*map(F.lit, KPIS))).alias("kpi")).select("*", F.explode(F.array(*map(F.lit, PERIODS))).alias("period"))
    return grid.select(F.concat_ws("-", "kpi", "period", "region").alias("case_id"), "kpi", "period", "region", F.lit(None).cast("string").alias("ceiling"))


def _accounts_of(spark, d):
    """Each case with the accounts of its region and its windows."""
    return windowed(openings(spark, d)).join(accounts(spark, d).select("account_id", "region"), "region").select("case_id", "account_id", "baseline", "start", "end")


@query(
    "spike_windows",
    f"""WITH {ACCOUNT}, {_TABLES}, {_CASES}, w AS (SELECT case_id, account_id, count(*) FILTER (WHERE day >= start_) AS window_count, count(*) FILTER (WHERE day < start_) AS baseline_count
          FROM cases JOIN account USING (region) JOIN ticket USING (account_id) WHERE day >= baseline AND day < end_ GROUP BY 1, 2)
        SELECT *, round(window_count / nullif(CAST(baseline_count AS DOUBLE), 0), 9) AS ratio FROM w""",
)
def spikes(spark, d):
    """Tickets of every account of every case, in the case's own two windows."""
    days = per_day(raw_tables(spark, d)["ticket"], ["account_id"], "created_at")
    return spike_counts(days, _accounts_of(spark, d), ["account_id"]).select("case_id", "account_id", "window_count", "baseline_count", F.round("ratio", 9).alias("ratio"))


@query(
    "incident_windows",
    f"""WITH {ACCOUNT}, {_TABLES}, {_CASES} SELECT case_id, count(DISTINCT incident_id) AS n_incidents, count(*) AS n_pairs, min(started_at) AS first_started
        FROM cases JOIN account USING (region) JOIN inc USING (account_id) WHERE started_at < end_ AND resolved_at >= start_ GROUP BY 1""",
)
def incidents(spark, d):
    """Incidents that overlap a case's window and name an account of it, of all cases."""
    inc = raw_tables(spark, d)["incident"].select("incident_id", "started_at", "resolved_at", F.explode(F.split("affected_accounts", r"\|")).alias("account_id"))
    windows = _accounts_of(spark, d).select("case_id", F.col("account_id").cast("string").alias("account_id"), "start", "end")
    met = overlapping(inc, windows, ["account_id"], "started_at", "resolved_at", skewed=True)
    return met.groupBy("case_id").agg(F.count_distinct("incident_id").alias("n_incidents"), F.count("*").alias("n_pairs"), F.min("started_at").alias("first_started"))


# a case's own accounts, those that cover its movement, and each test, as the definitions have them; f: the drivers
_SWEPT = f"""{SALES}, {ACCOUNT}, {_TABLES}, {_CASES},
  pa AS (SELECT 'net_sales' AS kpi, period, region, account_id, sum(CASE WHEN return_flag = 'R' THEN 0 ELSE amount_net END) AS num, 0.0 AS den FROM sales JOIN account USING (account_id) GROUP BY ALL
         UNION ALL SELECT 'discount_rate', period, region, account_id, sum(discount), sum(amount_gross) FROM sales JOIN account USING (account_id) WHERE qty <> 1 GROUP BY ALL),
  sd AS (SELECT case_id, c.kpi, account_id, coalesce(sum(num) FILTER (WHERE p.period = previous), 0) AS n0, coalesce(sum(num) FILTER (WHERE p.period = c.period), 0) AS n1,
                coalesce(sum(den) FILTER (WHERE p.period = previous), 0) AS d0, coalesce(sum(den) FILTER (WHERE p.period = c.period), 0) AS d1
         FROM cases c JOIN pa p ON p.kpi = c.kpi AND p.region = c.region AND p.period IN (c.period, previous) GROUP BY ALL),
  mv AS (SELECT *, CASE WHEN kpi = 'net_sales' THEN n1 - n0 ELSE coalesce(n1 / nullif(sum(d1) OVER w, 0), 0) - coalesce(n0 / nullif(sum(d0) OVER w, 0), 0) END AS delta,
                CASE WHEN kpi = 'net_sales' THEN n0 ELSE coalesce(n0 / nullif(d0, 0), 0) END AS pre, CASE WHEN kpi = 'net_sales' THEN n1 ELSE coalesce(n1 / nullif(d1, 0), 0) END AS post FROM sd WINDOW w AS (PARTITION BY case_id)),
  nd AS (SELECT case_id, account_id, delta, coalesce(sum(abs(delta)) OVER (PARTITION BY case_id ORDER BY abs(delta) DESC, CAST(account_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(delta)) OVER (PARTITION BY case_id) AS part FROM mv WHERE delta <> 0),
  ft AS (SELECT case_id, account_id, nd.delta, region, segment, start_, end_, baseline FROM nd JOIN cases c USING (case_id) JOIN account USING (account_id, region) WHERE part < 0.8),
  tot AS (SELECT case_id, sum(delta) AS total_delta, sum(delta) FILTER (WHERE part < 0.8) AS footprint_delta FROM nd GROUP BY 1),
  drv AS (SELECT case_id, driver, lag, start_, end_, CAST(start_ - lag AS DATE) AS since FROM cases, (VALUES ('pricing', 60), ('offer', 90), ('supply', 30)) v(driver, lag) WHERE driver <> 'pricing' OR kpi = 'net_sales'),
  sg AS (SELECT DISTINCT case_id, segment FROM ft),
  pr AS (SELECT d.case_id, segment, min(day) AS onset, bool_or(day >= start_ AND day < end_) AS inside FROM drv d JOIN sg ON sg.case_id = d.case_id JOIN book USING (segment) WHERE driver = 'pricing' AND day BETWEEN since AND end_ GROUP BY ALL),
  ons AS (SELECT case_id, 'pricing' AS driver, min(onset) AS onset FROM pr GROUP BY 1
          UNION ALL SELECT case_id, driver, min(day) FROM drv, news WHERE driver = 'offer' AND competitor IS NOT NULL AND day BETWEEN since AND end_ GROUP BY ALL
          UNION ALL SELECT case_id, driver, min(CAST(started_at AS DATE)) FROM drv, inc WHERE driver = 'supply' AND CAST(started_at AS DATE) BETWEEN since AND end_ GROUP BY ALL),
  ef AS (SELECT case_id, account_id, max(closed) AS effect_on FROM ft JOIN renewal USING (account_id) WHERE closed BETWEEN start_ AND end_ GROUP BY ALL),
  tm AS (SELECT case_id, driver, CASE WHEN bool_or(effect_on < onset OR effect_on > onset + lag) THEN 'refute' ELSE 'pass' END AS timing FROM ons JOIN drv USING (case_id, driver) JOIN ef USING (case_id) GROUP BY ALL),
  ca AS (SELECT case_id, 'pricing' AS driver, account_id FROM pr JOIN account USING (segment) UNION SELECT case_id, 'pricing', NULL FROM cases
         UNION SELECT case_id, driver, account_id FROM drv JOIN news n ON competitor IS NOT NULL AND day BETWEEN since AND end_ JOIN account USING (region) WHERE driver = 'offer'),
  lo AS (SELECT case_id, driver, count(DISTINCT f.account_id) / nullif(CAST(count(DISTINCT ca.account_id) + any_value(n) - count(DISTINCT f.account_id) AS DOUBLE), 0) AS j
         FROM ca LEFT JOIN ft f USING (case_id, account_id) JOIN (SELECT case_id, count(account_id) AS n FROM cases LEFT JOIN ft USING (case_id) GROUP BY 1) USING (case_id) GROUP BY ALL),
  pl AS (SELECT DISTINCT case_id, region, segment FROM ft),
  ct AS (SELECT case_id, post - pre AS d, f.account_id IS NOT NULL AS treated FROM mv JOIN account a USING (account_id) LEFT JOIN ft f USING (case_id, account_id) WHERE f.account_id IS NOT NULL OR (case_id, a.region, a.segment) IN (SELECT (case_id, region, segment) FROM pl)),
  cs AS (SELECT case_id, count(*) FILTER (WHERE NOT treated) AS k, sum(d) FILTER (WHERE NOT treated) AS s, avg(d) FILTER (WHERE treated) - avg(d) FILTER (WHERE NOT treated) AS effect FROM ct GROUP BY 1),
  cr AS (SELECT case_id, k, effect, 1 + count(*) FILTER (WHERE NOT treated AND abs(d - (s - d) / nullif(k - 1, 0)) > abs(effect)) AS r FROM ct JOIN cs USING (case_id) GROUP BY ALL),
  cn AS (SELECT case_id, CASE WHEN k < 5 OR effect IS NULL THEN 'inconclusive' WHEN r = 1 THEN 'pass' WHEN r > (k + 1) / 2 THEN 'refute' ELSE 'inconclusive' END AS control FROM cr),
  su AS (SELECT case_id, 'pricing' AS driver FROM pr WHERE inside UNION SELECT case_id, 'offer' FROM ft JOIN opp USING (account_id) WHERE day >= start_ AND day < end_
         UNION SELECT case_id, 'supply' FROM ft JOIN inc USING (account_id) WHERE started_at < end_ AND resolved_at >= start_),
  bk AS (SELECT case_id, account_id, product_id, nullif(coalesce(sum(qty) FILTER (WHERE s.period = previous), 0), 0) AS q0, nullif(coalesce(sum(qty) FILTER (WHERE s.period = c.period), 0), 0) AS q1,
                sum(amount_net) FILTER (WHERE s.period = previous) AS a0, sum(amount_net) FILTER (WHERE s.period = c.period) AS a1
         FROM cases c JOIN account USING (region) JOIN sales s USING (account_id) WHERE s.period IN (c.period, previous) GROUP BY ALL),
  px AS (SELECT case_id, sum((coalesce(a1 / q1, a0 / q0) - coalesce(a0 / q0, a1 / q1)) * coalesce(q0, 0)) AS price FROM bk WHERE q0 IS NOT NULL OR q1 IS NOT NULL GROUP BY 1),
  mx AS (SELECT d.case_id, d.driver, coalesce(timing, 'inconclusive') AS timing, CASE WHEN j > 0.5 THEN 'pass' WHEN j < 0.2 THEN 'refute' ELSE 'inconclusive' END AS locality, 'inconclusive' AS dose, coalesce(control, 'inconclusive') AS control,
                su.driver IS NOT NULL OR coalesce(timing, '') = 'pass' OR coalesce(j, 0) > 0.5 AS found_support, total_delta, footprint_delta, CASE WHEN d.driver = 'pricing' THEN price END AS price_effect
         FROM drv d LEFT JOIN tm USING (case_id, driver) LEFT JOIN lo USING (case_id, driver) LEFT JOIN cn USING (case_id) LEFT JOIN su USING (case_id, driver) LEFT JOIN tot USING (case_id) LEFT JOIN px USING (case_id)),
  tr AS (SELECT *, 'refute' IN (timing, locality, dose, control) AS refuted, (timing = 'pass')::INT + (locality = 'pass')::INT + (dose = 'pass')::INT + (control = 'pass')::INT AS passes, 'inconclusive' IN (timing, locality, dose, control) AS undecided FROM mx),
  ti AS (SELECT *, CASE WHEN refuted OR passes < 2 OR NOT (timing = 'pass' OR locality = 'pass') THEN NULL WHEN control = 'pass' AND NOT undecided THEN 'confirmed' ELSE 'likely' END AS tier FROM tr),
  co AS (SELECT *, CASE count(tier) OVER w WHEN 0 THEN 'undetermined' WHEN 1 THEN max(tier) OVER w ELSE 'contested' END AS confidence FROM ti WINDOW w AS (PARTITION BY case_id)),
  st AS (SELECT *, CASE WHEN tier IS NOT NULL THEN CASE WHEN confidence = 'contested' THEN 'unresolved' ELSE 'primary' END WHEN found_support THEN 'minor' WHEN refuted THEN 'eliminated' ELSE 'unresolved' END AS status FROM co),
  sh AS (SELECT *, CASE WHEN status IN ('primary', 'unresolved') THEN footprint_delta / nullif(total_delta, 0) WHEN status = 'minor' THEN price_effect / nullif(total_delta, 0) END AS share,
                abs(total_delta) * CASE confidence WHEN 'confirmed' THEN 1.0 WHEN 'likely' THEN 0.8 WHEN 'contested' THEN 0.6 ELSE 0.4 END AS priority FROM st)"""


@query("swept_cases", f"WITH {_SWEPT} SELECT case_id, driver, timing, locality, dose, control, status, confidence, round(share, 6) + 0.0 AS share, round(priority, 4) AS priority FROM sh")
def cases(spark, d):
    """Every case of some contracts and periods, investigated in one plan. Onsets of tickets are change points, which SQL doesn't have, so their driver isn't among these."""
    return _swept(spark, d, ["pricing", "offer", "supply"])


@query("swept_with_spikes")
def cases_with_spikes(spark, d):
    """The same with a driver whose onset is a change point of the tickets."""
    return _swept(spark, d, [*_DRIVERS])


def _swept(spark, d, drivers):
    of = {"net_sales": drivers, "discount_rate": [x for x in drivers if x != "pricing"]}  # prices move amounts
    contracts = [dataclasses.replace(CONTRACTS[k], drivers=tuple(Driver(x, probe=_DRIVERS[x][0], max_lag_days=_DRIVERS[x][1]) for x in of[k])) for k in KPIS]
    out = investigated(model(spark, d), contracts, openings(spark, d), raw_tables(spark, d))
    return out.select("case_id", "driver", "timing", "locality", "dose", "control", "status", "confidence", (F.round("share", 6) + F.lit(0.0)).alias("share"), F.round("priority", 4).alias("priority"))

"""Verdicts, recommendations, entitlements, feedback and the case store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import alias, band, scrubbed
from tidemark.operators.challenge import TESTS
from tidemark.operators.entitle import collapse, redactions, rows, rows_by_rule
from tidemark.operators.feedback import gates, priors, reordered
from tidemark.operators.incremental import continued, next_period
from tidemark.operators.names import without_names
from tidemark.operators.outcome import adjudicate, priority, questions, recommend
from tidemark.operators.store import latest, noise_share, rollup, telemetry
from tidemark.plans.contract import Persona, contract_of
from tidemark.queries import ACCOUNT, SALES, query
from tidemark.sources.star import accounts, sales, table

CONTRACT = contract_of(
    {
        "id": "net_sales",
        "formula": "SUM(sales.amount_net)",
        "owner_role": "cfo",
        "materiality": {"relative": 0.03, "absolute": 1000.0},
        "drivers": [
            {"id": "integration", "max_lag_days": 45, "probe": "ticket_spike", "lever": {"action": "prioritise_integration_fix", "owner_role": "vp_engineering", "save_rate": [0.75, 1.0]}},
            {"id": "pricing_change", "max_lag_days": 60, "probe": "price_delta", "lever": {"action": "pricing_review", "owner_role": "cro", "save_rate": [0.3, 0.6]}},
            {"id": "season", "type": "external_uncontrollable"},
        ],
        "access": {
            "row": {"region": {"cfo": ["*"], "vp_sales": ["own_region"], "auditor": ["ASIA", "EUROPE"]}},
            "column": {"account_name": ["cfo"], "amount_net": ["cfo"]},
            "domain": {"segment": {"support": ["BUILDING", "MACHINERY"]}},
        },
    }
)

# One case an order: three causes, whose test outcomes are spread over all combinations by the order's number.
_OUT = lambda e: f"CASE ({e}) % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'inconclusive' ELSE 'refute' END"
_CASES_SQL = f"""cases AS (SELECT o_orderkey AS case_id, d.driver AS driver, {_OUT('o_orderkey + d.i')} AS timing, {_OUT('o_orderkey // 3 + d.i')} AS locality, {_OUT('o_orderkey // 9 + 2 * d.i')} AS dose, {_OUT('o_orderkey // 27')} AS control,
    (o_orderkey // 5 + d.i) % 2 = 0 AS found_support, o_orderkey % 41 = 0 AS unmodelled, CASE WHEN o_orderkey % 7 = 0 THEN 'likely' END AS ceiling, o_totalprice * 0.8 AS footprint_delta, o_totalprice AS total_delta,
    CASE WHEN d.driver = 'pricing_change' THEN o_totalprice * 0.1 END AS price_effect FROM orders, (VALUES (0, 'integration'), (1, 'pricing_change'), (2, 'season')) d(i, driver))"""


def _cases(spark, d) -> DataFrame:
    drivers = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("driver")) for i, n in enumerate(("integration", "pricing_change", "season"))))).alias("d")
    o = table(spark, d, "orders").select("*", drivers)
    k, i = F.col("o_orderkey"), F.col("d.i")
    out = lambda e: F.when(F.pmod(e, F.lit(3)) == 0, "pass").when(F.pmod(e, F.lit(3)) == 1, "inconclusive").otherwise("refute")
    return o.select(
        k.alias("case_id"), "d.driver", out(k + i).alias("timing"), out(F.floor(k / 3) + i).alias("locality"), out(F.floor(k / 9) + 2 * i).alias("dose"), out(F.floor(k / 27)).alias("control"),
        ((F.floor(k / 5) + i) % 2 == 0).alias("found_support"), (k % 41 == 0).alias("unmodelled"), F.when(k % 7 == 0, "likely").alias("ceiling"),
        (F.col("o_totalprice") * 0.8).alias("footprint_delta"), F.col("o_totalprice").alias("total_delta"), F.when(F.col("d.driver") == "pricing_change", F.col("o_totalprice") * 0.1).alias("price_effect"),
    )


_TIERS = f"""{_CASES_SQL}, n AS (SELECT *, CAST(timing = 'pass' AS INTEGER) + CAST(locality = 'pass' AS INTEGER) + CAST(dose = 'pass' AS INTEGER) + CAST(control = 'pass' AS INTEGER) AS passes,
    CASE WHEN timing = 'refute' THEN 'timing' WHEN locality = 'refute' THEN 'locality' WHEN dose = 'refute' THEN 'dose' WHEN control = 'refute' THEN 'control' END AS refuted_by FROM cases),
  t AS (SELECT *, CASE WHEN refuted_by IS NOT NULL OR passes < 2 OR NOT (timing = 'pass' OR locality = 'pass') THEN NULL WHEN passes = 4 THEN 'confirmed' ELSE 'likely' END AS tier FROM n),
  c AS (SELECT *, CASE WHEN bool_or(unmodelled) OVER w OR count(tier) OVER w = 0 THEN 'undetermined' WHEN count(tier) OVER w > 1 THEN 'contested' WHEN max(tier) OVER w = 'confirmed' AND ceiling = 'likely' THEN 'likely' ELSE max(tier) OVER w END AS confidence FROM t WINDOW w AS (PARTITION BY case_id)),
  s AS (SELECT *, CASE WHEN tier IS NOT NULL THEN CASE WHEN confidence = 'contested' THEN 'unresolved' ELSE 'primary' END WHEN found_support THEN 'minor' WHEN refuted_by IS NOT NULL THEN 'eliminated' ELSE 'unresolved' END AS status FROM c),
  h AS (SELECT *, CASE WHEN status IN ('primary', 'unresolved') THEN footprint_delta / nullif(total_delta, 0) WHEN status = 'minor' THEN price_effect / nullif(total_delta, 0) END AS share FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY list_position(['primary', 'unresolved', 'minor', 'eliminated'], status), coalesce(round(share, 6), 0) DESC, driver) AS rank FROM h)"""


def _ranked(spark, d) -> DataFrame:
    return adjudicate(_cases(spark, d), ["case_id"])


@query("adjudicate_rubric", f"WITH {_TIERS} SELECT case_id, driver, tier, refuted_by, confidence, status, round(share, 6) AS share FROM r")
def verdicts(spark, d):
    return _ranked(spark, d).select("case_id", "driver", "tier", "refuted_by", "confidence", "status", F.round("share", 6).alias("share"))


@query(
    "case_priority",
    f"WITH {_TIERS} SELECT case_id, confidence, round(abs(total_delta) * CASE confidence WHEN 'confirmed' THEN 1.0 WHEN 'likely' THEN 0.8 WHEN 'contested' THEN 0.6 ELSE 0.4 END, 4) AS priority FROM r WHERE rank = 1",
)
def priorities(spark, d):
    return _ranked(spark, d).where("rank = 1").select("case_id", "confidence", F.round(priority(F.col("total_delta"), F.col("confidence")), 4).alias("priority"))


@query(
    "recommended_actions",
    f"""WITH {_TIERS} SELECT case_id, driver, CASE driver WHEN 'integration' THEN 'vp_engineering' ELSE 'cro' END AS owner_role, CASE driver WHEN 'integration' THEN 'Prioritise the integration fix for the footprint.' ELSE 'Review pricing for the footprint.' END AS action,
        round(abs(total_delta) * CASE driver WHEN 'integration' THEN 0.75 ELSE 0.3 END, 4) AS impact_low, round(abs(total_delta) * CASE driver WHEN 'integration' THEN 1.0 ELSE 0.6 END, 4) AS impact_high FROM r WHERE status = 'primary' AND driver <> 'season'""",
)
def actions(spark, d):
    return recommend(_ranked(spark, d), CONTRACT, F.lit("")).select("case_id", "driver", "owner_role", "action", F.round("impact_low", 4).alias("impact_low"), F.round("impact_high", 4).alias("impact_high"))


@query(
    "open_questions",
    f"""WITH {_TIERS} SELECT case_id, driver, CASE driver WHEN 'integration' THEN 'vp_engineering' WHEN 'pricing_change' THEN 'cro' ELSE 'cfo' END AS owner_role, round(abs(footprint_delta), 4) AS value_at_stake,
        CASE WHEN 'inconclusive' IN (timing, locality, dose, control) THEN 'Did ' || replace(driver, '_', ' ') || ' actually influence the outcome for the footprint? Ask the account owner(s).'
             ELSE 'What actually happened to the footprint? The available sources have no coverage of ' || replace(driver, '_', ' ') || '.' END AS question FROM r WHERE rank = 1 AND confidence <> 'confirmed'""",
)
def asked(spark, d):
    return questions(_ranked(spark, d), CONTRACT, F.lit("")).select("case_id", "driver", "owner_role", F.round("value_at_stake", 4).alias("value_at_stake"), "question")


@query("row_entitlement", f"WITH {ACCOUNT} SELECT * FROM (SELECT 'vp_europe' AS viewer, account_id, region FROM account WHERE region = 'EUROPE' UNION ALL SELECT 'auditor', account_id, region FROM account WHERE region IN ('ASIA', 'EUROPE') UNION ALL SELECT 'cfo', account_id, region FROM account)")
def entitled(spark, d):
    rules = spark.createDataFrame([("cfo", "*"), ("vp_sales", "own_region"), ("auditor", "ASIA"), ("auditor", "EUROPE")], "role_key string, allowed string")
    viewers = spark.createDataFrame([("cfo", "cfo", None), ("vp_europe", "vp_sales", "EUROPE"), ("auditor", "auditor", None), ("guest", "guest", None), ("vp_lost", "vp_sales", None)], "viewer string, role_key string, region string")
    return rows_by_rule(accounts(spark, d).select("account_id", "region"), rules, viewers.withColumnRenamed("region", "own").select("viewer", "role_key", F.col("own").alias("region")), "region")


@query("row_filter", f"WITH {ACCOUNT} SELECT account_id, segment FROM account WHERE region = 'ASIA'")
def filtered(spark, d):
    return rows(accounts(spark, d), CONTRACT, Persona("vp_asia", "vp_sales", region="ASIA"), ["region"]).select("account_id", "segment")


_DELTAS = f"""{SALES}, {ACCOUNT}, dl AS (SELECT account_id, segment, region, sum(amount_net * CASE WHEN period = '2001-07' THEN 1 ELSE -1 END) AS delta FROM sales JOIN account USING (account_id) WHERE period IN ('2001-06', '2001-07') GROUP BY 1, 2, 3),
  nd AS (SELECT *, delta / sum(delta) OVER () AS share FROM dl)"""


def _deltas(spark, d):
    lines = sales(spark, d).where("sold_on BETWEEN DATE '2001-06-01' AND DATE '2001-07-31'").join(accounts(spark, d), "account_id")
    out = lines.groupBy("account_id", "segment", "region").agg(F.sum(F.when(F.month("sold_on") == 7, F.col("amount_net")).otherwise(-F.col("amount_net"))).alias("delta"))
    total = out.agg(F.sum("delta").alias("t"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("delta") / F.col("t")).drop("t")  # one row


@query(
    "domain_collapse",
    f"""WITH {_DELTAS} SELECT 'account' AS dimension, CAST(account_id AS VARCHAR) AS key, round(delta, 4) AS delta FROM nd WHERE segment IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT 'account', count(*) || ' accounts (segment restricted)', round(sum(delta), 4) FROM nd WHERE segment NOT IN ('BUILDING', 'MACHINERY')""",
)
def collapsed(spark, d):
    nodes = _deltas(spark, d).withColumn("dimension", F.lit("account")).withColumn("key", F.col("account_id").cast("string"))
    return collapse(nodes, CONTRACT.access.domain["segment"]["support"], "segment").select("dimension", "key", F.round("delta", 4).alias("delta"))


@query("mask_hash_alias", "SELECT c_custkey, 'Account ' || left(sha256(CAST(c_custkey AS VARCHAR)), 4) AS alias FROM customer")
def aliases(spark, d):
    return table(spark, d, "customer").select("c_custkey", alias(F.col("c_custkey")).alias("alias"))


_BAND = "CASE WHEN abs(v) < 1 THEN 'under ₹1 Cr' WHEN abs(v) < 5 THEN '₹1–5 Cr' WHEN abs(v) < 25 THEN '₹5–25 Cr' WHEN abs(v) < 100 THEN '₹25–100 Cr' ELSE 'over ₹100 Cr' END"


@query("band_amount", f"SELECT o_orderkey, CASE WHEN v < 0 THEN '−' ELSE '' END || {_BAND} AS band FROM (SELECT o_orderkey, (o_totalprice - 100000) * 5000 / 10000000.0 AS v FROM orders)")
def bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", band((F.col("o_totalprice") - 100000) * 5000).alias("band"))


@query(
    "scrub_prose",
    r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(t, 'customer number', '[restricted]', 'gi'), 'customer', '[restricted]', 'gi'), '\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d{5,}(?:\.\d+)?\b', '[amount restricted]', 'g') AS prose
        FROM (SELECT c_custkey, 'Customer NUMBER ' || c_custkey || ' (' || c_name || ') owes 1,234,567.50 or ' || (c_custkey * 1000) || ' in 2001-07, 87.5%' AS t FROM customer)""",
)
def prose(spark, d):
    key = F.col("c_custkey").cast("string")
    t = F.concat(F.lit("Customer NUMBER "), key, F.lit(" ("), F.col("c_name"), F.lit(") owes 1,234,567.50 or "), (F.col("c_custkey") * 1000).cast("string"), F.lit(" in 2001-07, 87.5%"))
    return table(spark, d, "customer").select("c_custkey", scrubbed(t, ["customer", "customer number"]).alias("prose"))


@query(
    "scrub_names",
    """WITH c AS (SELECT c_custkey AS k, c_name AS n, c_custkey % 50 + 1 AS o FROM customer), a AS (SELECT c_custkey AS k, c_name AS n, 'Account ' || left(sha256(CAST(c_custkey AS VARCHAR)), 4) AS alias FROM customer)
       SELECT c.k AS c_custkey, 'From ' || x.alias || ' (buyer ' || c.k || ' of ' || y.alias || '), not ' || c.n || 'x, by ' || y.alias || '.' AS prose FROM c JOIN a x ON x.k = c.k JOIN a y ON y.k = c.o""",
)
def named(spark, d):
    """All customers' names, in two spellings, out of texts that have some of them; a longer word that begins like a name stays."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 50 + 1).alias("o"))
    other = c.select(F.col("c_custkey").alias("o"), F.col("c_name").alias("m"))
    text = F.concat(F.lit("From "), F.upper("c_name"), F.lit(" (buyer "), F.col("c_custkey").cast("string"), F.lit(" of "), "m", F.lit("), not "), "c_name", F.lit("x, by partner "), F.col("o").cast("string"), F.lit("."))
    docs = c.join(other, "o").select("c_custkey", text.alias("prose"))
    names = c.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name")).unionByName(c.select(F.col("c_custkey").alias("account_id"), F.concat(F.lit("Partner "), F.col("c_custkey").cast("string")).alias("name")))
    return without_names(docs, names, "prose")


@query("redactions_stated", f"WITH {ACCOUNT} SELECT * FROM (SELECT 'row' AS surface, 'region' AS field, count(*) AS n FROM account WHERE region <> 'ASIA' UNION ALL SELECT 'domain', 'segment', count(*) FROM account WHERE segment NOT IN ('BUILDING', 'MACHINERY')) WHERE n > 0")
def stated(spark, d):
    return redactions(accounts(spark, d), CONTRACT, Persona("vp_asia", "vp_sales", region="ASIA"), ["region"], CONTRACT.access.domain["segment"] and {"segment": CONTRACT.access.domain["segment"]["support"]})


_MARKS = """marks AS (SELECT 'kpi' || user_id % 3 AS kpi, 'driver' || user_id % 5 AS driver, 'region=' || user_id % 2 AS segment, CASE event_id % 5 WHEN 0 THEN 'correct_driver' WHEN 1 THEN 'not_material' WHEN 2 THEN 'missed_cause' ELSE 'wrong_driver' END AS kind FROM events)"""


def _marks(spark, d):
    e = table(spark, d, "events")
    s = lambda prefix, n: F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))
    k = F.col("event_id") % 5
    return e.select(s("kpi", 3).alias("kpi"), s("driver", 5).alias("driver"), s("region=", 2).alias("segment"), F.when(k == 0, "correct_driver").when(k == 1, "not_material").when(k == 2, "missed_cause").otherwise("wrong_driver").alias("kind"))


_PRIOR = f"""{_MARKS}, prior AS (SELECT kpi, driver, segment, CAST(sum(CASE kind WHEN 'correct_driver' THEN 1.0 ELSE -1.0 END) AS DOUBLE) AS prior FROM marks WHERE kind IN ('correct_driver', 'wrong_driver') GROUP BY 1, 2, 3)"""


@query("feedback_prior", f"WITH {_PRIOR} SELECT *, CASE WHEN prior <= -2 THEN 'probe_only' ELSE 'full' END AS depth FROM prior")
def learnt(spark, d):
    return priors(_marks(spark, d))


@query("feedback_order", f"WITH {_PRIOR} SELECT kpi, segment, driver, prior, row_number() OVER (PARTITION BY kpi, segment ORDER BY prior DESC, CAST(right(driver, 1) AS INTEGER), driver) AS place FROM prior")
def order(spark, d):
    p = priors(_marks(spark, d))
    out = reordered(p.select("kpi", "segment", "driver", F.right("driver", F.lit(1)).cast("int").alias("priority")), p)
    return out.select("kpi", "segment", "driver", "prior", F.col("place").cast("long").alias("place"))


@query("feedback_gates", f"WITH {_MARKS}, n AS (SELECT kpi, least(count(*), 10) AS n FROM marks WHERE kind = 'not_material' GROUP BY 1) SELECT kpi, round(CAST(0.03 + 0.01 * n AS DOUBLE), 9) AS relative, round(CAST(1000.0 * pow(1.05, n) AS DOUBLE), 6) AS absolute FROM n UNION ALL SELECT 'unmarked', CAST(0.03 AS DOUBLE), CAST(1000.0 AS DOUBLE)")
def widened(spark, d):
    base = _marks(spark, d).select("kpi").distinct().unionByName(spark.range(1).select(F.lit("unmarked").alias("kpi"))).select("kpi", F.lit(0.03).alias("relative"), F.lit(1000.0).alias("absolute"))
    return gates(_marks(spark, d), base).select("kpi", F.round("relative", 9).alias("relative"), F.round("absolute", 6).alias("absolute"))


_VERSIONS = """versions AS (SELECT 'case-' || o_custkey AS case_id, o_orderdate AS updated_at, o_orderkey AS version, o_totalprice AS delta, o_totalprice * 0.8 AS priority, CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed_at_verify' ELSE 'closed' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN 'contested' WHEN 1 THEN 'undetermined' ELSE 'likely' END AS confidence FROM orders),
  newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY updated_at DESC, version DESC) AS n FROM versions) WHERE n = 1)"""


def _versions(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("case-"), F.col("o_custkey").cast("string")).alias("case_id"), F.col("o_orderdate").alias("updated_at"), k.alias("version"), F.col("o_totalprice").alias("delta"), (F.col("o_totalprice") * 0.8).alias("priority"),
        F.when(k % 3 == 0, "open").when(k % 3 == 1, "closed_at_verify").otherwise("closed").alias("status"), F.when(k % 4 == 0, "contested").when(k % 4 == 1, "undetermined").otherwise("likely").alias("confidence"),
    )


@query("case_upsert_latest", f"WITH {_VERSIONS} SELECT case_id, version, status, round(delta, 4) AS delta FROM newest")
def upsert(spark, d):
    return latest(_versions(spark, d)).select("case_id", "version", "status", F.round("delta", 4).alias("delta"))


@query(
    "case_list_rollup",
    f"""WITH {_VERSIONS} SELECT count(*) AS n_cases, count(*) FILTER (WHERE status = 'open') AS n_open, round(sum(abs(delta)) FILTER (WHERE status = 'open'), 4) AS open_delta, count(*) FILTER (WHERE status = 'closed_at_verify') AS n_closed_at_verify,
        count(*) FILTER (WHERE status = 'open' AND confidence IN ('contested', 'undetermined')) AS n_needs_decision FROM newest""",
)
def rolled(spark, d):
    return rollup(latest(_versions(spark, d))).withColumn("open_delta", F.round("open_delta", 4))


@query(
    "telemetry_rollup",
    "SELECT user_id AS case_id, CAST(sum(event_id % 3) AS BIGINT) AS calls, round(sum(value), 4) AS cost, round(sum(value * 10) / 1000, 6) AS seconds, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS deterministic_share FROM events GROUP BY 1",
)
def usage(spark, d):
    stages = table(spark, d, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 3).alias("calls"), F.col("value").alias("cost"), (F.col("value") * 10).alias("wall_ms"))
    return telemetry(stages).select("case_id", "calls", F.round("cost", 4).alias("cost"), F.round("seconds", 6).alias("seconds"), F.round("deterministic_share", 9).alias("deterministic_share"))


@query("document_noise_share", "SELECT round(avg(CASE WHEN lang <> 'en' THEN 1.0 ELSE 0.0 END), 9) AS noise_share FROM documents")
def noise(spark, d):
    return noise_share(table(spark, d, "documents").select((F.col("lang") != "en").alias("is_noise"))).withColumn("noise_share", F.round("noise_share", 9))


def _lines(spark, d):
    line = table(spark, d, "lineitem")
    return line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("ship"), F.max("l_quantity").cast("long").alias("qty"), F.round(F.max("l_extendedprice"), 2).alias("amount_gross"), F.max("l_linestatus").alias("status")).select(
        F.col("l_orderkey").cast("string").alias("invoice_id"), F.col("l_linenumber").alias("line_no"), F.to_date("ship").alias("invoice_date"), "qty", F.round(F.col("amount_gross") / F.col("qty"), 2).alias("unit_price"), "amount_gross", F.lit(0.0).alias("discount"), F.col("amount_gross").alias("amount_net"),
        (F.col("status") == "F").cast("int").alias("is_recurring"), F.col("ship").cast("timestamp_ntz").alias("_ingested_at"),
    )


@query(
    "ingest_next_period",
    """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS ship, CAST(max(l_quantity) AS BIGINT) AS qty, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2), m AS (SELECT max(date_trunc('month', ship)) AS m FROM l)
       SELECT strftime(m + INTERVAL 1 MONTH, '%Y-%m') AS period, count(*) AS n_lines, CAST(coalesce(sum(qty) FILTER (WHERE status = 'F'), 0) AS BIGINT) AS recurring_qty FROM l, m WHERE date_trunc('month', ship) = m GROUP BY 1""",
)
def ingest(spark, d):
    lines = _lines(spark, d)
    out = continued(lines, 7).agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(F.when(F.col("is_recurring") == 1, F.col("qty"))), F.lit(0)).alias("recurring_qty"))
    return next_period(lines).crossJoin(out)  # one row each


@query("test_outcomes", f"WITH {_CASES_SQL} SELECT timing, locality, dose, control, count(*) AS n FROM cases GROUP BY 1, 2, 3, 4")
def outcomes(spark, d):
    return _cases(spark, d).groupBy(*TESTS).agg(F.count("*").alias("n"))

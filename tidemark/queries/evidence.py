"""Probes, retrieval and tests of causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import one_spaced, quotes, tokens
from tidemark.operators.challenge import as_evidence, dose, locality, matrix, peers, region_peers, timing
from tidemark.operators.decompose import contributions, footprint
from tidemark.operators.evidence import incident_scan, price_delta, read_spike, reason_scan, supported_claims, ticket_spike
from tidemark.operators.nearest import nearest as nearest_of
from tidemark.operators.retrieval import KeptIndex, bm25, funnel, recall, scope, top
from tidemark.plans.panel import bounds
from tidemark.queries import ACCOUNT, SALES, query
from tidemark.queries.decompose import COVERED, PREVIOUS
from tidemark.sources.scratch import scratch, settled
from tidemark.sources.star import CONTRACTS, CURRENT, accounts, model, sales, table, tickets

ERRORS = "category = 'error'"
WINDOW = ("2024-01-16", "2024-01-31", "2024-01-01", "2024-01-16")

_SPIKE = f"""sp AS (SELECT user_id AS account_id, count(*) FILTER (WHERE ts >= '2024-01-16' AND ts < '2024-01-31') AS window_count, count(*) FILTER (WHERE ts >= '2024-01-01' AND ts < '2024-01-16') AS baseline_count
  FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts >= '2024-01-01' AND ts < '2024-01-31' GROUP BY 1), spike AS (SELECT *, window_count / nullif(CAST(baseline_count AS DOUBLE), 0) AS ratio FROM sp)"""


def _spikes(spark, d):
    errors = tickets(spark, d).where(ERRORS)
    return ticket_spike(errors, errors.select("account_id"), *WINDOW)


def _effect(spark, d):
    """The accounts that cover the movement of net sales."""
    nodes = contributions(model(spark, d), CONTRACTS["net_sales"], ["account_id"], CURRENT, PREVIOUS)
    return footprint(nodes).select(F.col("key").cast("long").alias("account_id"))


@query("event_spike_ratio", f"WITH {_SPIKE} SELECT account_id, window_count, baseline_count, round(ratio, 9) AS ratio FROM spike")
def spike(spark, d):
    return _spikes(spark, d).withColumn("ratio", F.round("ratio", 9))


@query(
    "spike_evidence",
    f"""WITH {_SPIKE} SELECT account_id, CASE WHEN ratio IS NULL THEN 'uncheckable' ELSE 'found' END AS outcome, ratio >= 1.5 AS supports, round(CASE WHEN ratio >= 1.5 THEN least(1.0, (ratio - 1) / 3) ELSE 0 END, 9) AS strength FROM spike""",
)
def reading(spark, d):
    return read_spike(_spikes(spark, d)).select("account_id", "outcome", "supports", F.round("strength", 9).alias("strength"))


@query(
    "filtered_counts",
    """SELECT lang, count(*) FILTER (WHERE n_chars < 2000) AS closed_lost, count(*) FILTER (WHERE n_chars < 2000 AND source <> '') AS populated, count(*) FILTER (WHERE n_chars < 2000 AND source IN ('src3', 'src5')) AS names_cause,
         CASE WHEN count(*) FILTER (WHERE n_chars < 2000 AND source <> '') = 0 THEN 'uncheckable' WHEN count(*) FILTER (WHERE n_chars < 2000 AND source IN ('src3', 'src5')) = 0 THEN 'checked_absent' ELSE 'found' END AS outcome
       FROM documents GROUP BY 1""",
)
def reasons(spark, d):
    return reason_scan(table(spark, d, "documents"), ["lang"], F.col("n_chars") < 2000, F.col("source"), ["src3", "src5"]).drop("share")


_BOOK = "book AS (SELECT p_brand AS segment, CAST(DATE '2001-01-01' + CAST(p_partkey % 400 AS INTEGER) AS DATE) AS effective_from, p_retailprice FROM part)"


@query(
    "price_effective_scan",
    f"""WITH {_BOOK} SELECT segment, count(*) AS n_rows, count(*) FILTER (WHERE effective_from >= '2001-07-01' AND effective_from < '2001-07-31') AS n_changes,
        CASE WHEN count(*) FILTER (WHERE effective_from >= '2001-07-01' AND effective_from < '2001-07-31') > 0 THEN 'found' ELSE 'checked_absent' END AS outcome FROM book WHERE segment LIKE '%1%' GROUP BY 1""",
)
def prices(spark, d):
    book = table(spark, d, "part").select(F.col("p_brand").alias("segment"), F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int")).alias("effective_from"), "p_retailprice")
    return price_delta(book, book.where("segment LIKE '%1%'").select("segment"), "2001-07-01", "2001-07-31")


_INCIDENTS = """inc AS (SELECT 'I' || (event_id // 200) AS incident_id, min(ts) AS started_at, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE max(ts) END AS resolved_at, string_agg(CAST(user_id AS VARCHAR), '|') AS affected_accounts, any_value('s') AS service
  FROM events WHERE event_type = 'error' GROUP BY 1)"""


@query(
    "incident_overlap_explode",
    f"""WITH {ACCOUNT}, {_INCIDENTS} SELECT DISTINCT incident_id, started_at, resolved_at FROM (SELECT *, unnest(string_split(affected_accounts, '|')) AS a FROM inc)
        WHERE a IN (SELECT CAST(account_id AS VARCHAR) FROM account WHERE region = 'ASIA') AND started_at < '2024-01-20' AND resolved_at >= '2024-01-02'""",
)
def incidents(spark, d):
    e = tickets(spark, d).where(ERRORS)
    key = F.concat(F.lit("I"), F.floor(F.col("ticket_id") / 200).cast("string"))
    inc = e.groupBy(key.alias("incident_id")).agg(
        F.min("created_at").alias("started_at"), F.when(F.count("*") % 3 != 0, F.max("created_at")).alias("resolved_at"), F.array_join(F.collect_list(F.col("account_id").cast("string")), "|").alias("affected_accounts"), F.lit("s").alias("service"), F.lit("high").alias("severity")
    )  # at most 200 events each
    return incident_scan(inc, accounts(spark, d).where("region = 'ASIA'"), "2024-01-02", "2024-01-20").select("incident_id", "started_at", "resolved_at")


def _documents(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), (F.col("conv_id") % 150).alias("account"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") % 30).cast("int")).alias("at"), F.coalesce("text", F.lit("")).alias("text"))


_DOCS = "docs AS (SELECT conv_id || '-' || turn AS doc_id, conv_id % 150 AS account, CAST(DATE '2024-01-01' + CAST(turn % 30 AS INTEGER) AS DATE) AS seen_on, coalesce(text, '') AS text FROM conversations)"


_EUROPE = "account IN (SELECT account_id FROM account WHERE region = 'EUROPE')"


@query("scoped_documents", f"WITH {_DOCS}, {ACCOUNT} SELECT doc_id, docs.account FROM docs WHERE docs.{_EUROPE} AND seen_on BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'")
def scoped(spark, d):
    return scope(_documents(spark, d), accounts(spark, d).where("region = 'EUROPE'"), "2024-01-03", "2024-01-04", 2).select("doc_id", "account")


_STOP = "the a an and or of to in on for with is are was were be been it its this that they them their we our you your i at by from as has have had not no but if"
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: NOT list_contains(string_split('{_STOP}', ' '), x))"


def _stem_sql(t: str) -> str:
    out = t
    for s in reversed(("iness", "ingly", "edly", "ings", "ies", "ing", "ers", "est", "ed", "es", "er", "s")):
        base = f"left({t}, length({t}) - {len(s)})"
        if s == "ies":
            value = f"{base} || 'y'"
        else:
            value = f"CASE WHEN length({base}) > 2 AND right({base}, 1) = left(right({base}, 2), 1) AND right({base}, 1) NOT IN ('l', 's', 'z') THEN left({base}, length({base}) - 1) ELSE {base} END"
        out = f"CASE WHEN length({t}) > {len(s) + 2} AND {t} LIKE '%{s}' THEN {value} ELSE {out} END"
    return out


@query("stemmed_tokens", f"WITH {_DOCS}, w AS (SELECT unnest({_TOKENS}) AS w FROM docs), s AS (SELECT {_stem_sql('w')} AS term FROM w) SELECT term, count(*) AS n FROM s GROUP BY 1")
def stems(spark, d):
    return _documents(spark, d).select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_QUERIES = [(1, "the thing of there"), (2, "intention heating and reading"), (3, "ation ing ed"), (4, "nothingatall")]
_BM25 = f"""{_DOCS}, w AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM docs), t AS (SELECT doc_id, {_stem_sql('w')} AS term FROM w), dl AS (SELECT docs.doc_id, greatest(count(term), 1) AS dl FROM docs LEFT JOIN t USING (doc_id) GROUP BY 1),
  st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  wt AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, st), me AS (SELECT avg(raw) AS m FROM wt),
  q0 AS (SELECT query_id, unnest({_TOKENS}) AS w FROM (VALUES {', '.join(f"({i}, '{q}')" for i, q in _QUERIES)}) v(query_id, text)), q AS (SELECT DISTINCT query_id, {_stem_sql('w')} AS term FROM q0),
  sc AS (SELECT query_id, doc_id, sum(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), me, st GROUP BY 1, 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM sc)"""


def _ranked(spark, d):
    q = spark.createDataFrame(_QUERIES, "query_id int, query string")
    scores = bm25(_documents(spark, d), q).withColumn("score", F.round("score", 8))
    return top(scores, ["doc_id"])


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 15")
def search(spark, d):
    return _ranked(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_index_topk", f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 15")
def search_index(spark, d):
    """The same ranking from an index that two batches filled, of which one came twice."""
    docs, index = _documents(spark, d), KeptIndex(spark, scratch(spark))
    for version, when in ((1, "at < '2024-01-03'"), (2, "at >= '2024-01-03'"), (1, "at < '2024-01-03'")):
        index.add(docs.where(when), version)
    scores = index.search(spark.createDataFrame(_QUERIES, "query_id int, query string")).withColumn("score", F.round("score", 8))
    return top(scores, ["doc_id"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_WANTED = "wanted AS (SELECT CAST(conv_id % 3 + 1 AS INTEGER) AS query_id, conv_id || '-' || turn AS doc_id FROM conversations WHERE length(text) > 300 AND turn < 2)"


@query("recall_at_k", f"WITH {_BM25}, {_WANTED} SELECT w.query_id, count(*) AS n_wanted, round(count(rk.doc_id) / count(*), 9) AS recall FROM wanted w LEFT JOIN rk ON rk.query_id = w.query_id AND rk.doc_id = w.doc_id AND rank <= 15 GROUP BY 1")
def found(spark, d):
    wanted = table(spark, d, "conversations").where("length(text) > 300 AND turn < 2").select((F.col("conv_id") % 3 + 1).cast("int").alias("query_id"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"))
    return recall(_ranked(spark, d), wanted).withColumn("recall", F.round("recall", 9))


@query(
    "cosine_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 20 = 0),
       s AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)), 0), 6) AS score FROM v, q)
       SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 15""",
)
def nearest(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return nearest_of(v, q)


@query("retrieval_funnel", f"WITH {_DOCS}, {ACCOUNT}, s AS (SELECT * FROM docs WHERE docs.{_EUROPE} AND seen_on BETWEEN DATE '2024-01-02' AND DATE '2024-01-04') SELECT (SELECT count(*) FROM docs) AS corpus, (SELECT count(*) FROM s) AS scoped, (SELECT count(*) FROM s WHERE length(text) > 100) AS returned, round(1 - (SELECT count(*) FROM s) / (SELECT count(*) FROM docs), 9) AS reduction")
def counts(spark, d):
    docs = _documents(spark, d)
    inside = scope(docs, accounts(spark, d).where("region = 'EUROPE'"), "2024-01-03", "2024-01-04", 2)
    return funnel(docs, inside, inside.where("length(text) > 100")).withColumn("reduction", F.round("reduction", 9))


@query(
    "quoted_claims",
    f"""WITH {_DOCS}, claims AS (SELECT doc_id, CASE conv % 3 WHEN 0 THEN '  ' || replace(substr(t, 5, 20), ' ', chr(10) || ' ') || ' ' WHEN 1 THEN 'never said this' ELSE substr(t, 1, 12) END AS quote
          FROM (SELECT doc_id, account AS conv, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM docs))
        SELECT doc_id FROM claims JOIN docs USING (doc_id) WHERE length(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) > 0 AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g')))""",
)
def claims(spark, d):
    docs = _documents(spark, d)
    t = one_spaced(F.col("text"))
    k = F.col("account") % 3
    quote = F.when(k == 0, F.concat(F.lit("  "), F.replace(F.substring(t, 5, 20), F.lit(" "), F.lit("\n ")), F.lit(" "))).when(k == 1, "never said this").otherwise(F.substring(t, 1, 12))
    return supported_claims(docs.select("doc_id", quote.alias("quote")), docs).select("doc_id")


def _causes(spark, d, spikes):
    hot = spikes.where("ratio >= 1.5").select(F.lit("integration").alias("driver"), "account_id")
    asia = accounts(spark, d).where("region = 'ASIA'").select(F.lit("competitor").alias("driver"), "account_id")
    nobody = spark.range(1).select(F.lit("pricing").alias("driver"), F.lit(None).cast("long").alias("account_id"))
    return hot.unionByName(asia).unionByName(nobody)


_FOOTPRINT = f"{COVERED}, effect AS (SELECT account_id FROM c WHERE part < 0.8)"
_CAUSES = f"""{_FOOTPRINT}, {_SPIKE}, causes AS (SELECT 'integration' AS driver, account_id FROM spike WHERE ratio >= 1.5 UNION ALL SELECT 'competitor', account_id FROM account WHERE region = 'ASIA' UNION ALL SELECT 'pricing', NULL)"""
_LOCAL = f"""{_CAUSES}, j AS (SELECT driver, count(DISTINCT c.account_id) AS n_cause, (SELECT count(*) FROM effect) AS n_effect, count(DISTINCT e.account_id) AS n_both FROM causes c LEFT JOIN effect e ON c.account_id = e.account_id GROUP BY 1),
  loc AS (SELECT driver, n_cause, n_effect, n_both / nullif(CAST(n_cause + n_effect - n_both AS DOUBLE), 0) AS overlap FROM j)"""


@query("locality_test", f"WITH {_LOCAL} SELECT driver, n_cause, n_effect, round(overlap, 9) AS overlap, CASE WHEN overlap > 0.5 THEN 'pass' WHEN overlap < 0.2 THEN 'refute' ELSE 'inconclusive' END AS outcome FROM loc")
def where(spark, d):
    return locality(_causes(spark, d, _spikes(spark, d)), settled(_effect(spark, d))).withColumn("overlap", F.round("overlap", 9))


_TIMING = f"""onset AS (SELECT * FROM (VALUES ('integration', DATE '2001-06-20', 45), ('competitor', DATE '2001-07-10', 90), ('pricing', DATE '2001-05-01', 20), ('unseen', CAST(NULL AS DATE), 30)) v(driver, onset, max_lag_days)),
  eff AS (SELECT account_id, max(sold_on) AS effect_on FROM sales WHERE period = '{CURRENT}' GROUP BY 1), lags AS (SELECT driver, date_diff('day', onset, effect_on) AS lag, max_lag_days AS m FROM onset, eff),
  o AS (SELECT *, CASE WHEN lag < 0 THEN -lag ELSE greatest(lag - m, 0) END AS outside FROM lags)"""


@query(
    "timing_lag",
    f"""WITH {SALES}, {_TIMING} SELECT driver, count(lag) AS n, CAST(any_value(w) AS DOUBLE) AS worst_lag, CASE WHEN count(lag) = 0 THEN 'inconclusive' WHEN max(outside) > 0 THEN 'refute' ELSE 'pass' END AS outcome
        FROM (SELECT *, first(lag) OVER (PARTITION BY driver ORDER BY outside DESC NULLS LAST, lag DESC NULLS LAST) AS w FROM o) GROUP BY 1""",
)
def when(spark, d):
    return _timing(spark, d).withColumn("worst_lag", F.col("worst_lag").cast("double"))


def _timing(spark, d):
    rows = [("integration", "2001-06-20", 45), ("competitor", "2001-07-10", 90), ("pricing", "2001-05-01", 20), ("unseen", None, 30)]
    onset = spark.createDataFrame(rows, "driver string, onset string, max_lag_days int").withColumn("onset", F.col("onset").cast("date"))
    start, end = bounds(F.lit(CURRENT))
    lines = sales(spark, d).where(F.col("sold_on").between(start, end))
    effects = lines.groupBy("account_id").agg(F.max("sold_on").alias("effect_on"))
    return timing(onset, onset.select("driver").crossJoin(effects))  # four drivers


def _dose(spark, d, spikes):
    change = sales(spark, d).groupBy("account_id").agg(F.sum("amount_net").alias("delta"))
    return dose(spikes.where("ratio IS NOT NULL").select(F.lit("integration").alias("driver"), "account_id", F.col("ratio").alias("intensity")), change)


@query(
    "dose_response",
    f"""WITH {_SPIKE}, {SALES}, t AS (SELECT account_id, ratio AS x, y FROM spike JOIN (SELECT account_id, sum(amount_net) AS y FROM sales GROUP BY 1) USING (account_id) WHERE ratio IS NOT NULL),
        r AS (SELECT *, row_number() OVER (ORDER BY x) AS px, row_number() OVER (ORDER BY y) AS py FROM t), m AS (SELECT avg(px) OVER (PARTITION BY x) AS rx, avg(py) OVER (PARTITION BY y) AS ry FROM r)
        SELECT 'integration' AS driver, count(*) AS n, round(corr(rx, ry), 9) AS rho, CASE WHEN corr(rx, ry) > 0.5 THEN 'pass' WHEN corr(rx, ry) < 0 THEN 'refute' ELSE 'inconclusive' END AS outcome FROM m""",
)
def how_much(spark, d):
    return _dose(spark, d, _spikes(spark, d)).withColumn("rho", F.round("rho", 9))


@query("peer_accounts", f"WITH {_FOOTPRINT}, f AS (SELECT * FROM account WHERE account_id IN (SELECT account_id FROM effect) AND region <> 'ASIA') SELECT account_id, region, segment FROM account WHERE (region, segment) IN (SELECT (region, segment) FROM f) AND account_id NOT IN (SELECT account_id FROM f)")
def peer_accounts(spark, d):
    a = accounts(spark, d)
    return peers(a, settled(a.where("region <> 'ASIA'").join(_effect(spark, d), "account_id", "left_semi"))).select("account_id", "region", "segment")


@query("region_peers", f"WITH {_SPIKE}, {ACCOUNT} SELECT account_id FROM account WHERE region IN (SELECT region FROM account WHERE account_id IN (SELECT account_id FROM spike WHERE ratio >= 6))")
def same_region(spark, d):
    a = accounts(spark, d)
    return region_peers(a, _spikes(spark, d).where("ratio >= 6")).select("account_id")


def _matrix(spark, d):
    control = spark.range(1).select(F.lit("pass").alias("outcome"))
    drivers = spark.createDataFrame([("integration",), ("competitor",), ("pricing",), ("unseen",)], "driver string")
    spikes, effect = settled(_spikes(spark, d)), settled(_effect(spark, d))
    return matrix({"timing": _timing(spark, d), "locality": locality(_causes(spark, d, spikes), effect), "dose": _dose(spark, d, spikes)}, drivers, control)


_MATRIX = f"""{_LOCAL}, {_TIMING}, drv AS (SELECT unnest(['integration', 'competitor', 'pricing', 'unseen']) AS driver),
  t1 AS (SELECT driver, CASE WHEN count(lag) = 0 THEN 'inconclusive' WHEN max(outside) > 0 THEN 'refute' ELSE 'pass' END AS timing FROM o GROUP BY 1),
  t2 AS (SELECT driver, CASE WHEN overlap > 0.5 THEN 'pass' WHEN overlap < 0.2 THEN 'refute' ELSE 'inconclusive' END AS locality FROM loc),
  dt AS (SELECT ratio AS x, y FROM spike JOIN (SELECT account_id, sum(amount_net) AS y FROM sales GROUP BY 1) USING (account_id) WHERE ratio IS NOT NULL), dr AS (SELECT x, y, row_number() OVER (ORDER BY x) AS px, row_number() OVER (ORDER BY y) AS py FROM dt),
  dm AS (SELECT avg(px) OVER (PARTITION BY x) AS rx, avg(py) OVER (PARTITION BY y) AS ry FROM dr), t3 AS (SELECT 'integration' AS driver, CASE WHEN corr(rx, ry) > 0.5 THEN 'pass' WHEN corr(rx, ry) < 0 THEN 'refute' ELSE 'inconclusive' END AS dose FROM dm),
  mx AS (SELECT driver, coalesce(timing, 'inconclusive') AS timing, coalesce(locality, 'inconclusive') AS locality, coalesce(dose, 'inconclusive') AS dose, 'pass' AS control FROM drv LEFT JOIN t1 USING (driver) LEFT JOIN t2 USING (driver) LEFT JOIN t3 USING (driver))"""


@query("challenge_matrix", f"WITH {_MATRIX} SELECT * FROM mx")
def tests(spark, d):
    return _matrix(spark, d)


@query(
    "challenge_evidence",
    f"""WITH {_MATRIX}, l AS (SELECT driver, unnest(['timing', 'locality', 'dose', 'control']) AS test, unnest([timing, locality, dose, control]) AS r FROM mx)
        SELECT 'ev-' || driver || '-' || test || '-001' AS id, test, CASE WHEN r = 'inconclusive' THEN 'uncheckable' ELSE 'found' END AS outcome, CASE WHEN r <> 'refute' THEN driver END AS supports, CASE WHEN r = 'refute' THEN driver END AS contradicts FROM l""",
)
def items(spark, d):
    return as_evidence(_matrix(spark, d)).select("id", "test", "outcome", "supports", "contradicts")


@query("quote_presence", f"WITH {_DOCS} SELECT account, count(*) FILTER (WHERE contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'the')) AS n FROM docs GROUP BY 1")
def presence(spark, d):
    return _documents(spark, d).groupBy("account").agg(F.count_if(quotes(F.col("text"), F.lit(" the "))).alias("n"))

"""Scoped retrieval: documents of a footprint, ranked by BM25 or by cosine, with recall and the funnel's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import tokens
from tidemark.sources.scratch import settled

#: Declared, as the definition leaves them to a library: saturation, length's part, and the floor of a negative weight.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP = 15

# Which tables an evidence source stands for, and how a table reads as a document:
# id, account (none for markets), time, title, body.
SOURCES = {
    "tickets": ("ticket", "ticket_message"),
    "crm_notes": ("opportunity_note",),
    "deploy_log": ("deploy_event",),
    "incident": ("incident",),
    "news": ("news_item",),
}
READERS = {
    "ticket": ("ticket_id", "account_id", "created_at", "subject", "body_text"),
    "ticket_message": ("message_id", "account_id", "created_at", "author_user_id", "body_text"),
    "opportunity_note": ("note_id", "account_id", "created_at", "author_user_id", "body_text"),
    "deploy_event": ("deploy_id", None, "deployed_at", "service", "change_summary"),
    "incident": ("incident_id", None, "started_at", "service", "severity"),
    "news_item": ("news_id", None, "published_at", "headline", "body_text"),
}
#: Tables that a search without a cause in mind reads: those whose rows belong to an account.
OF_ACCOUNTS = ("ticket", "ticket_message", "opportunity_note")


def documents(tables: dict[str, DataFrame], sources: list[str] | None = None) -> DataFrame:
    """doc_id, table, account, at, title, body of the tables that the sources stand for. Messages have the account of their ticket."""
    wanted = list(OF_ACCOUNTS) if sources is None else list(dict.fromkeys(t for s in sources for t in SOURCES.get(s, ())))
    out = None
    for name in wanted:
        key, account, at, title, body = READERS[name]
        df = tables[name]
        if name == "ticket_message":
            df = df.join(tables["ticket"].select("ticket_id", "account_id"), "ticket_id")
        part = df.select(F.col(key).alias("doc_id"), F.lit(name).alias("table"), (F.col(account) if account else F.lit(None).cast("string")).alias("account"), F.to_date(at).alias("at"), F.col(title).alias("title"), F.col(body).alias("body"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no table for sources {sources}")
    return out


def scope(docs: DataFrame, accounts: DataFrame, start: str, end: str, max_lag_days: int = 0) -> DataFrame:
    """The documents of the accounts, and those of none, from the window's start, or the longest lag before its end if that is earlier, to its end."""
    first = F.least(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), max_lag_days)) if max_lag_days else F.lit(start).cast("date")
    inside = docs.where(F.col("at").between(first, F.lit(end).cast("date")))
    known = accounts.select(F.col("account_id").alias("account")).distinct()
    return inside.where("account IS NOT NULL").join(known, "account", "left_semi").select(*docs.columns).unionByName(inside.where("account IS NULL"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """query_id, doc_id, score of documents that share a term with a query. docs: doc_id, text; queries: query_id, query.

    Okapi weights ln((N - df + 0.5) / (df + 0.5)); those under 0 are epsilon times the mean weight over all
    terms. Scores under 0 stay, documents without a shared term don't. The corpus is tokenised once, into a table of
    words a document. One pass over it counts the documents of each term and, as a row without a term, those of all;
    another keeps the words that queries ask for, whose rows alone are shuffled. queries is a stated set.
    """
    words = settled(docs.select("doc_id", tokens(F.col("text")).alias("words")))
    size = F.greatest(F.size("words"), F.lit(1))
    each = words.select(size.alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("words"))).alias("term"))
    counted = settled(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl")))
    stats = counted.where("term IS NULL").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = counted.where("term IS NOT NULL").select("term", "df").crossJoin(F.broadcast(stats)).withColumn("raw", raw)  # one row
    mean = weights.agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    weighed = settled(asked.join(weights, "term").crossJoin(F.broadcast(mean)).select("query_id", "term", "avgdl", idf.alias("idf")))  # one row; then Spark knows its size
    hit = words.select("doc_id", size.alias("dl"), F.explode("words").alias("term")).join(weighed, "term")
    tf = hit.groupBy("query_id", "doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("avgdl").alias("avgdl"), F.first("idf").alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top(scores: DataFrame, ties: list[str], k: int = TOP) -> DataFrame:
    """Adds rank, 1 to k for each query, by score and then by the tie columns."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class KeptIndex:
    """Postings of a corpus that grows by batches: a text is tokenised once, when it comes in, and searches read words only.

    postings: term, doc_id, tf, by parts of the terms' hash; lengths: doc_id, dl; terms: term, df. Each batch writes its own
    folder, so one that comes again replaces itself. A document comes in one batch. One writer at a time.
    """

    PARTS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, docs: DataFrame, version: int) -> None:
        """Takes in doc_id and text of a batch."""
        words = settled(docs.select("doc_id", tokens(F.col("text")).alias("words")))
        to = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={version}")
        to(words.select("doc_id", F.greatest(F.size("words"), F.lit(1)).alias("dl")), "lengths")
        counts = settled(words.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
        to(counts.groupBy("term").agg(F.count("*").alias("df")), "terms")
        parts = counts.withColumn("part", self._part("term")).repartition("part")
        parts.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/batch={version}")

    def _part(self, term: str):
        return F.pmod(F.xxhash64(term), F.lit(self.PARTS)).cast("int")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").drop("batch")

    def search(self, queries: DataFrame, scope: DataFrame | None = None, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
        """query_id, doc_id, score as by bm25() over the documents of scope (doc_id), or of all.

        Document counts and mean length are the scope's own. Of the postings, all terms' document counts are kept; only a
        scope asks for a pass over the postings' ids, and no search for a text. Of the others only parts that have a query's term are read.
        """
        lengths, postings = self._read("lengths"), self._read("postings")
        if scope is None:
            counted = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        else:
            ids = settled(scope.select("doc_id").distinct())
            lengths, postings = lengths.join(ids, "doc_id", "left_semi"), postings.join(ids, "doc_id", "left_semi")
            counted = postings.groupBy("term").agg(F.count("*").alias("df"))
        stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = settled(counted.crossJoin(F.broadcast(stats)).withColumn("raw", raw))  # one row
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
        mean = F.broadcast(weights.agg(F.avg("raw").alias("mean_idf")))  # one row
        weighed = settled(asked.join(weights, "term").crossJoin(mean).select("query_id", "term", self._part("term").alias("part"), "avgdl", idf.alias("idf")))
        hit = postings.join(weighed, ["part", "term"]).join(lengths, "doc_id")
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def recall(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, n_wanted, recall: the part of the wanted documents among the ranked ones; a query without any isn't in the result."""
    found = wanted.select("query_id", "doc_id").distinct().join(ranked.select("query_id", "doc_id").distinct().withColumn("_f", F.lit(1)), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg(F.count("*").alias("n_wanted"), (F.count("_f") / F.count("*")).alias("recall"))


def funnel(corpus: DataFrame, scoped: DataFrame, returned: DataFrame) -> DataFrame:
    """corpus, scoped, returned and reduction, the part of the corpus that scoping leaves out."""
    a, b, c = (df.agg(F.count("*").alias(n)) for df, n in ((corpus, "corpus"), (scoped, "scoped"), (returned, "returned")))
    return a.crossJoin(b).crossJoin(c).withColumn("reduction", 1 - F.try_divide(F.col("scoped").cast("double"), F.nullif(F.col("corpus").cast("double"), F.lit(0.0))))  # one row each

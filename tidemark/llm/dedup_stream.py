"""Operator 4: exact deduplication by a stateful stream over disk-backed keyed state without expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.shared import WIDE_ROWS, ascii_lower, exists, looked_up, removed, settings, shared_dir, touched, without, written

#: Many small stores: changes are uploaded as they are, no file takes more disk than it has content, the stores of
#: an executor share a bound on memory, and each is closed when its task has committed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
SEEN = "run int, at long, doc_id long, digest binary"
LOCATOR = "struct<doc_id: long, run: int, at: long>"
#: Micro-batches in which a run reads its files, so that most of the texts meet state that is on disk.
BATCHES = 3
#: Up to this many digests of repeated texts (32 bytes each) are broadcast to pick the texts to compare; more are joined.
BROADCAST_DIGESTS = 500_000
#: A group's kept text is compared with at most this many copies in one task.
COPIES_A_TASK = 500


def normal(text: Column) -> Column:
    """The text that counts: null as empty, A-Z in lower case, nothing else changed."""
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


_HIDDEN = -(2**63)


class ExactDeduplicator:
    """Keeps, for each distinct text ever seen, its digest, the stable identifier that stays (the largest
    doc_id) with its content locator, and the number of rows, in RocksDB under folder.

    The inbox holds the rows of all runs, once; a locator is the run and the row's number in the inbox, which is never
    numbered anew. Each observe() is one more run of the same stream: it reads what is new in the inbox, in several
    micro-batches, updates the state by digest and appends the changed keys to a table of versions. A lost
    executor's part is read back from the state's checkpoint; a repeated batch overwrites its own version.
    """

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.inbox, self.versions, self.checkpoint = spark, f"{folder}/inbox", f"{folder}/versions", f"{folder}/state"
        self.digest = digest

    def observe(self, docs: DataFrame, batches: int = BATCHES) -> None:
        """Reads doc_id and text of every row, and keeps the row with all its columns."""
        run = 0
        while exists(self.spark, f"{self.inbox}/run={run}/_whole"):
            run += 1
        rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("at"), self.digest(normal(F.col("text"))).alias("digest"), F.struct("*").alias("row"))
        rows.write.mode("overwrite").options(**WIDE_ROWS).parquet(f"{self.inbox}/run={run}")  # what a run left that broke off is written over
        touched(self.spark, f"{self.inbox}/run={run}/_whole")
        self.row = docs.schema
        files = len(self.spark.read.schema("at long").parquet(f"{self.inbox}/run={run}").inputFiles())
        state = (
            self.spark.readStream.schema(SEEN)
            .option("maxFilesPerTrigger", max(1, -(-files // batches)))
            .parquet(self.inbox)
            .groupBy("digest")
            .agg(F.max(F.struct(F.coalesce("doc_id", F.lit(_HIDDEN)).alias("doc_id"), "run", "at")).alias("kept"), F.count("*").alias("group_size"))
        )

        def changed(batch: DataFrame, version: int) -> None:
            batch.select("digest", "kept", "group_size").write.mode("overwrite").parquet(f"{self.versions}/version={version}")

        with settings(self.spark, STATE):
            query = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()

    def groups(self) -> DataFrame:
        """digest, kept (doc_id, run, at), group_size: the newest version of each key. A key's size only grows."""
        versions = self.spark.read.schema(f"digest binary, kept {LOCATOR}, group_size long").parquet(f"{self.versions}/version=*")
        return versions.groupBy("digest").agg(F.max_by("kept", "group_size").alias("kept"), F.max("group_size").alias("group_size"))

    def rows(self) -> DataFrame:
        """The rows of all runs: run, at, doc_id, digest, and the row itself; only what is asked for of it is read."""
        return self.spark.read.schema(StructType.fromDDL(SEEN).add("row", self.row)).parquet(self.inbox)

    def texts(self) -> DataFrame:
        return self.rows().withColumn("text", F.col("row.text")).drop("row")


def differing(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows (run, at, doc_id, digest, text) whose full bytes aren't those of the row that their group's locator names.

    Only texts of repeated digests are moved. Copies are dealt out by a salt, as many for a group as its
    size asks for, and the kept text, fetched by its locator, goes to each of the salts.
    """
    repeated = groups.where("group_size > 1").select("digest", "kept", "group_size")
    n, total = groups.agg(F.count_if(F.col("group_size") > 1), F.sum("group_size")).first()
    if not n:
        return rows.where("false").withColumn("content", normal(F.col("text")))
    # of more than can be broadcast, only the hot ones are: the others have few rows each
    hits = rows.join(F.broadcast(repeated), "digest") if n <= BROADCAST_DIGESTS else looked_up(rows, repeated, "digest", "group_size", total).where("group_size IS NOT NULL")
    hits = hits.withColumn("content", normal(F.col("text"))).drop("text")
    salts = F.ceil(F.col("group_size") / COPIES_A_TASK)
    located = (F.col("run") == F.col("kept.run")) & (F.col("at") == F.col("kept.at"))
    fetched = hits.where(located).select("digest", F.col("content").alias("content_kept"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = hits.where(~located).withColumn("salt", F.pmod(F.xxhash64("run", "at"), salts))
    return dealt.join(fetched, ["digest", "salt"]).where(F.col("content") != F.col("content_kept")).select("run", "at", "doc_id", "digest", "content")


def _by_content(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of digests that several texts share, grouped by the texts themselves: run, at, doc_id, digest, kept, group_size."""
    mine = rows.join(digests, "digest", "left_semi").withColumn("content", normal(F.col("text"))).drop("text")
    each = mine.groupBy("digest", "content").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(_HIDDEN)).alias("doc_id"), "run", "at")).alias("kept"), F.count("*").alias("group_size"))
    return mine.join(each, ["digest", "content"]).drop("content")


def _judged(dedup: ExactDeduplicator, folder: str) -> DataFrame:
    """run, at, doc_id, digest, kept and group_size of the rows of all runs."""
    groups = written(dedup.groups(), f"{folder}/groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    wrong = written(differing(dedup.texts(), groups).select("digest").distinct(), f"{folder}/shared")
    out = looked_up(dedup.rows().drop("row"), groups, "digest", "group_size", total)
    if not wrong.head(1):
        return out
    return out.join(wrong, "digest", "left_anti").unionByName(_by_content(dedup.texts(), wrong))


def exact_groups(docs: DataFrame, folder: str | None = None, batches: int = BATCHES, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal after lower-casing A-Z, the one with the largest doc_id stays; of rows that
    repeat that doc_id too, the last by run and place, so exactly one row of a group is kept. A null text is the
    empty text; a null doc_id is less than any other. Extra columns are ignored. No row, no result. Texts of one
    digest whose bytes differ are groups of their own.

    In a folder that is given, all state is kept: a later call goes on from it, and its result has the rows
    of all calls, as the row of an earlier one may no longer be the one that stays.
    """
    spark = docs.sparkSession
    own, folder = folder is None, folder or shared_dir(spark)
    dedup = ExactDeduplicator(spark, folder, digest)
    dedup.observe(docs.select("doc_id", F.col("text").cast("string").alias("text")), batches)
    out = _judged(dedup, shared_dir(spark))
    if own:
        removed(spark, dedup.versions)
        removed(spark, dedup.checkpoint)
    return out.select(
        "doc_id",
        F.when(F.col("kept.doc_id") != _HIDDEN, F.col("kept.doc_id")).alias("keep_id"),
        "group_size",
        _stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _stays() -> Column:
    return (F.col("run") == F.col("kept.run")) & (F.col("at") == F.col("kept.at"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called; which, see exact_groups()."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    dedup = ExactDeduplicator(spark, folder)
    dedup.observe(docs)
    place = F.struct("run", "at").alias("place")
    out = without(dedup.rows().select("row", place), _judged(dedup, f"{folder}/judged").where(~_stays()).select(place), f"{folder}/dropped")
    removed(spark, dedup.versions)
    removed(spark, dedup.checkpoint)
    return out

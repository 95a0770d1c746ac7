"""The case store: one row a case, the newest version of each; lists, rollups and telemetry over it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.raw import exists, folders, put_new, removed, replaced
from tidemark.sources.scratch import settled


def latest(versions: DataFrame) -> DataFrame:
    """The newest row of each case_id by updated_at, and by version between equals. One aggregation, which combines before it shuffles."""
    rest = [c for c in versions.columns if c != "case_id"]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "version")).alias("r")
    return versions.groupBy("case_id").agg(newest).select("case_id", *(f"r.{c}" for c in rest)).select(*versions.columns)


class CaseStore:
    """Versions of cases, appended to a folder; what is read is the newest version of each, so a repeated save changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, cases: DataFrame) -> None:
        cases.write.mode("append").parquet(self.path)

    def numbered(self, cases: DataFrame) -> DataFrame:
        """cases with version, one more than the newest in the store, 1 for those that aren't there."""
        if not exists(self.spark, self.path):
            return cases.withColumn("version", F.lit(1).cast("long"))
        known = self.spark.read.option("mergeSchema", "true").parquet(self.path).groupBy("case_id").agg(F.max("version").alias("_known"))
        return cases.join(known, "case_id", "left").withColumn("version", F.coalesce("_known", F.lit(0)) + F.lit(1).cast("long")).drop("_known")

    def cases(self, open_only: bool = False) -> DataFrame:
        if not exists(self.spark, self.path):
            raise FileNotFoundError(self.path)
        out = latest(self.spark.read.option("mergeSchema", "true").parquet(self.path))
        return (out.where("status = 'open'") if open_only else out).orderBy(F.desc("priority"), "case_id")

    def load(self, case_id: str) -> DataFrame:
        return self.cases().where(F.col("case_id") == case_id)

    def compact(self) -> None:
        """Leaves one version of each case: written beside the folder first, then swapped."""
        latest(self.spark.read.option("mergeSchema", "true").parquet(self.path)).write.mode("overwrite").parquet(f"{self.path}.new")
        replaced(self.spark, self.path)


class BucketedStore:
    """The newest version of each case, in buckets by hash of case_id, with a numbered list of the folders that count.

    path/data/<id>/bucket=<b> hold rows, path/lists/<n>.json says which folder each bucket is in. A list is written aside and
    renamed into place, which fails if another writer has that number: then the merge is done anew over what they wrote.
    So an upsert rewrites the buckets that it touches, no writer loses another's rows, and what breaks off counts for nothing.
    Folders that no list names any more are left for vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _newest(self) -> tuple[int, dict[str, str]]:
        numbers = [int(f.removesuffix(".json")) for f in folders(self.spark, f"{self.path}/lists") if f.endswith(".json")]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/lists/{max(numbers):012d}.json", wholetext=True).first().value
        return max(numbers), json.loads(text)

    def _committed(self, number: int, where: dict[str, str]) -> bool:
        return put_new(self.spark, f"{self.path}/lists/{number:012d}.json", json.dumps(where, sort_keys=True))

    def _read(self, where: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in where.items()]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def upsert(self, cases: DataFrame, attempts: int = 10) -> int:
        """Takes in versions of cases (case_id, updated_at, version and more); the number of the list that has them. Doing it again changes nothing."""
        new = settled(cases.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(self.buckets)).cast("int")))
        touched = {str(r.bucket) for r in new.select("bucket").distinct().collect()}  # at most as many as buckets
        for _ in range(attempts):
            number, where = self._newest()
            old = self._read({b: f for b, f in where.items() if b in touched})
            rows = new if old is None else new.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(self.buckets)).cast("int")), allowMissingColumns=True)
            folder = uuid.uuid4().hex
            latest(rows).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            if self._committed(number + 1, where | dict.fromkeys(touched, folder)):
                return number + 1
        raise RuntimeError(f"{attempts} other writers were first each time")

    def cases(self, open_only: bool = False) -> DataFrame:
        out = self._read(self._newest()[1])
        if out is None:
            raise FileNotFoundError(self.path)
        return (out.where("status = 'open'") if open_only else out).orderBy(F.desc("priority"), "case_id")

    def load(self, case_id: str) -> DataFrame:
        """One case, from its bucket alone."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(case_id)), F.lit(self.buckets)).cast("int")).first()[0]
        where = self._newest()[1]
        if str(bucket) not in where:
            raise KeyError(case_id)
        return self._read({str(bucket): where[str(bucket)]}).where(F.col("case_id") == case_id)

    def vacuum(self) -> int:
        """Deletes the folders that the newest list doesn't name, while nobody reads or writes; how many they were."""
        named = set(self._newest()[1].values())
        stale = [f for f in folders(self.spark, f"{self.path}/data") if f not in named]
        for f in stale:
            removed(self.spark, f"{self.path}/data/{f}")
        return len(stale)


def rollup(cases: DataFrame) -> DataFrame:
    """n_cases, n_open, open_delta (sum of sizes), n_closed_at_verify, n_needs_decision."""
    open_ = F.col("status") == "open"
    return cases.agg(
        F.count("*").alias("n_cases"),
        F.count_if(open_).alias("n_open"),
        F.coalesce(F.sum(F.when(open_, F.abs("delta"))), F.lit(0.0)).alias("open_delta"),
        F.count_if(F.col("status") == "closed_at_verify").alias("n_closed_at_verify"),
        F.count_if(open_ & F.col("confidence").isin("contested", "undetermined")).alias("n_needs_decision"),
    )


def telemetry(stages: DataFrame) -> DataFrame:
    """case_id, calls, cost, seconds, deterministic_share: over the stages of a case; those without a call used no model."""
    return stages.groupBy("case_id").agg(
        F.sum("calls").alias("calls"), F.sum("cost").alias("cost"), (F.sum("wall_ms") / 1000).alias("seconds"), F.avg(F.when(F.col("calls") == 0, 1.0).otherwise(0.0)).alias("deterministic_share")
    )


def noise_share(docs: DataFrame) -> DataFrame:
    return docs.agg(F.avg(F.col("is_noise").cast("double")).alias("noise_share"))


def ledger_conflicts(items: DataFrame) -> DataFrame:
    """Ids of an append-only ledger that stand for different items."""
    w = Window.partitionBy("id")
    return items.withColumn("_n", F.size(F.collect_set(F.xxhash64("claim", "outcome")).over(w))).where("_n > 1").select("id").distinct()

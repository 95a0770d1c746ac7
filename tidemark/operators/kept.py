"""A panel that is kept as rows come in: what each batch adds to each slice and month is written once, and a sweep merges
what is there of the months that it looks at, without reading a record again."""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.contract import Contract
from tidemark.plans.gathered import KNOWN, Gathered
from tidemark.plans.panel import Model
from tidemark.sources.raw import exists, folders, removed, replaced

_MERGED = "upto"


class KeptPanel:
    """Partial sums, counts and maxima in folders path/batch=table-version/period=yyyy-MM, of some contracts and dimensions.

    A batch that comes again replaces what it wrote, so nothing counts twice. A late row is in the month of its own
    date, whatever batch brings it. Slices are those that accounts have when a batch comes in. Medians don't add up, so
    contracts with one are an error. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, contracts: list[Contract], dims: list[str]):
        medians = [c.id for c in contracts if any(t.aggregate == "MEDIAN" for t in c.parsed.terms)]
        if medians:
            raise ValueError(f"a median can't be added up from batches: {', '.join(medians)}")
        self.spark, self.path, self.contracts, self.dims = spark, path, contracts, dims

    def _named(self, asked: Gathered) -> list[tuple[str, str, str, str]]:
        """Of each column: its name in a Gathered, a name that other columns don't change, how it merges, and its table."""
        out = []
        for base, columns in asked.columns.items():
            for key, (name, _, merge) in columns.items():
                stable = "m" + hashlib.sha256(repr((base.table, base.subqueries, key)).encode()).hexdigest()[:16]
                out.append((name, stable, merge, base.table))
        return out

    def _merged_upto(self, table: str) -> int:
        """The newest version of a table that merged() has taken in, 0 without any."""
        found = [int(f.rpartition("-")[2]) for f in folders(self.spark, self.path) if f.startswith(f"batch={table}-{_MERGED}-")]
        return max(found, default=0)

    def add(self, model: Model, table: str, rows: DataFrame, version: int) -> None:
        """Takes in a batch of a table's rows. version: from 1 on, one number a batch; a batch that is there already is replaced, one that was merged since is left out."""
        if version <= self._merged_upto(table):
            return
        facts = {n: dataclasses.replace(f, df=rows if n == table else f.df.where("false")) for n, f in model.facts.items()}
        asked = Gathered(dataclasses.replace(model, facts=facts), self.contracts, self.dims)
        own = [(name, stable) for name, stable, _, of in self._named(asked) if of == table]
        out = asked.rows.select("period", *self.dims, KNOWN, *(F.col(n).alias(s) for n, s in own))
        out.repartition("period").write.mode("overwrite").partitionBy("period").parquet(f"{self.path}/batch={table}-{version}")

    def _partials(self) -> DataFrame:
        if not exists(self.spark, self.path):
            raise FileNotFoundError(self.path)
        return self.spark.read.option("mergeSchema", "true").option("basePath", self.path).parquet(self.path)

    def _merged(self, asked: Gathered, parts: DataFrame, *more: str) -> DataFrame:
        there = set(parts.columns)
        how = {"sum": F.sum, "max": F.max}
        sums = {s: how[merge](s) for _, s, merge, _ in self._named(asked) if s in there}
        return parts.groupBy("period", *self.dims, KNOWN, *more).agg(*(v.alias(s) for s, v in sums.items()))

    def gathered(self, model: Model, first: str, last: str) -> Gathered:
        """As gathered() of the same contracts and dimensions, from the kept rows of the months from first to last."""
        asked = Gathered(model, self.contracts, self.dims, first, last)
        rows = self._merged(asked, self._partials().where(F.col("period").cast("string").between(first, last)))
        names = [F.col(s).alias(n) if s in rows.columns else F.lit(None).cast("double").alias(n) for n, s, *_ in self._named(asked)]
        asked.rows = rows.select(F.col("period").cast("string").alias("period"), *self.dims, KNOWN, *names)
        return asked

    def merged(self, model: Model) -> None:
        """Leaves one partial row a slice, month and table instead of one a batch: written beside the folder, then swapped."""
        asked, parts = Gathered(model, self.contracts, self.dims), self._partials()
        newest = {}
        for f in folders(self.spark, self.path):
            table, _, version = f.removeprefix("batch=").rpartition("-")
            table = table.removesuffix(f"-{_MERGED}")
            newest[table] = max(newest.get(table, 0), int(version))
        removed(self.spark, f"{self.path}.new")
        table_of = F.regexp_extract("batch", rf"^(.*?)(-{_MERGED})?-\d+$", 1)
        for table, version in newest.items():
            rows = self._merged(asked, parts.where(table_of == table)).withColumn("period", F.col("period").cast("string"))
            own = [s for _, s, _, of in self._named(asked) if of == table and s in rows.columns]
            rows.select("period", *self.dims, KNOWN, *own).repartition("period").write.partitionBy("period").parquet(f"{self.path}.new/batch={table}-{_MERGED}-{version}")
        replaced(self.spark, self.path)

"""The nearest vectors of many queries: blocks of unit vectors as matrices, block products, and a k-best that merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import on_workers
from tidemark.sources.scratch import settled

#: Vectors and queries of a block: a task multiplies one block of each, whatever the numbers of both.
VECTORS, QUERIES = 32_768, 2_048


def _block(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """df in blocks of about so many rows, dealt by its rows' hash, and the number of blocks."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.xxhash64(*df.columns), F.lit(n))), n


def _units(t: pa.Table, column: str) -> np.ndarray:
    flat = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(t.num_rows, -1)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 15, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank: for each query its k vectors of the highest cosine, rounded, ties to the smaller doc_id.

    vectors: doc_id, v; queries: query_id, q. A vector that is null, empty, zero or has a component that is null or not finite has no score and
    isn't found; only vectors of the query's length meet it. Each block of queries meets each block of vectors in one
    task, which keeps k a query; these meet in a window that keeps k before they move, so no pair of rows is ever put out.
    """
    on_workers(vectors.sparkSession)
    fine = lambda c: F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)
    left = settled(vectors.where(fine("v")).select("doc_id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("size")))
    right = settled(queries.where(fine("q")).select("query_id", F.col("q").cast("array<double>").alias("q"), F.size("q").alias("size")))
    (left, n), (right, m) = _block(left, VECTORS, "_of"), _block(right, QUERIES, "_by")
    schema = f"query_id {right.schema['query_id'].dataType.simpleString()}, doc_id {left.schema['doc_id'].dataType.simpleString()}, score double"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        docs, asked = a.column("doc_id").combine_chunks(), b.column("query_id").combine_chunks()
        rows, cols, values = [], [], []
        if len(docs) and len(asked):
            by_id = np.asarray(pc.sort_indices(docs))  # ties are then by place
            scores = np.round(_units(b, "q") @ _units(a, "v").T, digits)[:, by_id]
            for i, s in enumerate(scores):
                least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2.0
                some = np.flatnonzero(s >= least)
                best = some[np.argsort(-s[some], kind="stable")[:k]]
                rows.append(np.full(len(best), i))
                cols.append(by_id[best])
                values.append(s[best])
        take = lambda x, at: x.take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        return pa.table({"query_id": take(asked, rows), "doc_id": take(docs, cols), "score": np.concatenate(values) if values else np.zeros(0)})

    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
    keys = ["size", "_of", "_by"]
    found = left.withColumn("_by", each(m)).groupBy(*keys).cogroup(right.withColumn("_of", each(n)).groupBy(*keys)).applyInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

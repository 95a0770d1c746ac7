"""Operator 11: exact top-k by inner product, block at a time, pruned by bounds from each block's maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import on_workers, settings, shared_dir, written

#: Rows in a block, rows in a shard of blocks, and queries in a chunk: a task scores one chunk against one shard.
BLOCK, SHARD, CHUNK = 128, 16_384, 2_048
#: Below this, sums of products are exact in doubles.
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
_CHUNKS = "chunk long, row binary, id binary, vectors binary, width long"
_BLOCKS = "shard long, block long, row binary, id binary, unnamed binary, vectors binary, maxima binary, minima binary, width long"
_FOUND = "chunk long, query_row long, query_id long, row long, vec_id long, score long"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers as 64-bit integers, exact; what doesn't fit saturates one above the least and at the greatest."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) >= EXACT:
        whole = [[int(x) for x in r] for r in a], [[int(x) for x in r] for r in b]
        return np.array([[min(max(sum(map(int.__mul__, x, y)), LEAST + 1), MOST) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(a), len(b))
    return (a @ b.T).astype(np.int64)


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Best:
    """The k best candidates of each of n queries so far: by score, then the smaller id, then the smaller row."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.row = np.full((n, k), LEAST), np.full((n, k), MOST), np.full((n, k), MOST)

    def take(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates for the queries numbered in `of`: a row of scores each, of the same ids and rows."""
        some = np.flatnonzero((scores >= self.score[of, -1:]).any(1))
        if not len(some):
            return
        of, k, wide = of[some], self.score.shape[1], (len(some), len(ids))
        s = np.concatenate([self.score[of], scores[some]], 1)
        i = np.concatenate([self.id[of], np.broadcast_to(ids, wide)], 1)
        r = np.concatenate([self.row[of], np.broadcast_to(rows, wide)], 1)
        r = np.where(s == LEAST, MOST, r)  # nothing there, or the query itself
        order = np.lexsort((r, i, ~s), axis=-1)[:, :k]
        self.score[of], self.id[of], self.row[of] = (np.take_along_axis(x, order, 1) for x in (s, i, r))


def pruned_search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, blocks: list[dict], k: int) -> tuple[Best, int]:
    """The k best rows of the blocks for each query but itself (own: its row), and how many pairs of query and block were scored.

    A block's bound is the sum over terms of the most that a member may add: the query's part times the block's maximum,
    or its minimum where the part is negative. Each query takes the blocks by falling bound and stops below its k-th
    score, or below `least`, which k rows elsewhere reach. In a turn, queries that take the same block are scored together.
    """
    best, scored = Best(len(queries), k), 0
    width = max([queries.shape[1], *(b["vectors"].shape[1] for b in blocks)])
    queries = _padded(queries, width)
    for b in blocks:
        b["vectors"] = _padded(b["vectors"], width)
    maxima, minima = (np.concatenate([_padded(b[n], width) for b in blocks]) for n in ("maxima", "minima"))
    bounds = product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1), np.concatenate([maxima, minima], 1))
    least_id = np.array([b["id"].min() for b in blocks])
    order = np.argsort(~bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(len(blocks)):
        at = order[active, turn]
        bound, kth = bounds[active, at], best.score[active, -1]
        on = bound >= np.maximum(kth, least[active])
        active, at = active[on], at[on]
        if not len(active):
            break
        worth = (bounds[active, at] > best.score[active, -1]) | (least_id[at] <= best.id[active, -1])
        by = np.argsort(at[worth], kind="stable")
        some, where = active[worth][by], at[worth][by]
        scored += len(some)
        for of in np.split(some, np.flatnonzero(np.diff(where)) + 1) if len(some) else ():
            b = blocks[order[of[0], turn]]
            scores = product(queries[of], b["vectors"])
            best.take(of, np.where(b["row"] == own[of][:, None], LEAST, scores), b["id"], b["row"])
    return best, scored


def _matrix(arrays: list[list[float]]) -> np.ndarray:
    """The arrays rounded down, as rows of one width."""
    width = max(map(len, arrays))
    out = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return np.floor(out)


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers, 4 bytes each where they fit; the number of bytes says which."""
    return m.astype("<i4" if np.abs(m).max(initial=0) < 2**31 else "<f8").tobytes()


def _unpacked(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * rows * width else "<f8").astype(float).reshape(rows, width)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """row, id and vectors of up to `most` rows at a time, in order."""
    row, ids, vectors = [], [], []
    for batch in batches:
        row += batch.column("row").to_pylist()
        ids += batch.column("id").to_pylist()
        vectors += batch.column("vector").to_pylist()
        while len(row) >= most:
            yield np.array(row[:most]), ids[:most], _matrix(vectors[:most])
            row, ids, vectors = row[most:], ids[most:], vectors[most:]
    if row:
        yield np.array(row), ids, _matrix(vectors)


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    for n, (row, ids, m) in enumerate(_groups(batches, BLOCK)):
        key = np.array([MOST if i is None else i for i in ids], "<i8")
        out = {"shard": shard, "block": n, "row": row.astype("<i8").tobytes(), "id": key.tobytes(), "unnamed": np.array([i is None for i in ids]).tobytes()}
        out |= {"vectors": _packed(m), "maxima": _packed(m.max(0, keepdims=True)), "minima": _packed(m.min(0, keepdims=True)), "width": m.shape[1]}
        yield pa.RecordBatch.from_pylist([out], _arrow(_BLOCKS))


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId()
    for row, ids, m in _groups(batches, 1 << 62):
        out = {"chunk": chunk, "row": row.astype("<i8").tobytes(), "id": np.array(ids, "<i8").tobytes(), "vectors": _packed(m), "width": m.shape[1]}
        yield pa.RecordBatch.from_pylist([out], _arrow(_CHUNKS))


def _unit(k: int):
    """The k best of a shard for each query of a chunk; chunks may have the rows and least scores that were found for them before."""

    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        found = {n: [] for n, _ in (x.split() for x in _FOUND.split(", "))}
        shard = []
        for b in blocks.to_pylist():
            ids = np.frombuffer(b["id"], "<i8")
            one = {"id": ids, "row": np.frombuffer(b["row"], "<i8"), "unnamed": np.frombuffer(b["unnamed"], bool), "vectors": _unpacked(b["vectors"], len(ids), b["width"])}
            shard.append(one | {n: _unpacked(b[n], 1, b["width"]) for n in ("maxima", "minima")})
        unnamed = np.concatenate([b["row"][b["unnamed"]] for b in shard]) if shard else np.zeros(0, np.int64)
        for c in chunks.to_pylist() if shard else ():
            own, ids = np.frombuffer(c["row"], "<i8"), np.frombuffer(c["id"], "<i8")
            known = {r["query_row"]: r["least"] for r in c.get("known") or ()}
            least = np.array([known.get(r, LEAST) for r in own.tolist()])
            best, _ = pruned_search(_unpacked(c["vectors"], len(own), c["width"]), own, least, shard, k)
            q, at = np.nonzero(best.row != MOST)
            rows = best.row[q, at]
            for name, values in (("chunk", np.full(len(q), c["chunk"])), ("query_row", own[q]), ("query_id", ids[q]), ("row", rows), ("score", best.score[q, at])):
                found[name].append(pa.array(values, pa.int64()))
            found["vec_id"].append(pa.array(best.id[q, at], pa.int64(), mask=np.isin(rows, unnamed)))
        return pa.table({n: pa.chunked_array(parts, pa.int64()) for n, parts in found.items()}, schema=_arrow(_FOUND))

    return run


def top_k(rows: DataFrame, query: Column, k: int = 10, scale: int = 1024, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query, the k other rows with the highest inner product.

    Reads vec_id and embedding, ignores other columns. Components become floor(scale * x). A vector that is null or has
    a component that is null or not finite takes no part, neither as a query; a shorter vector lacks the terms of a longer one, an empty
    one scores 0. Ties go to the smaller vec_id; a null id is the greatest and may be found, but where query is null a row is no query. Rows that repeat an id
    are rows of their own: each query finds all rows but its own, so two queries of one id give two lists. A score that
    64 bits don't hold saturates. With fewer rows there are fewer ranks; no row gives no result.

    Rows are put in order by their greatest term, and go in ranges to shards of blocks (a forward index each, and its maxima and
    minima), queries to chunks; each pair of a chunk and a shard is a task of a bounded size. Each chunk first searches one
    shard, whose k-th scores bound what the others need to look at. The best of all shards meet in a window that keeps k rows a
    query and task before they move.
    """
    spark = rows.sparkSession
    on_workers(spark)
    folder = shared_dir(spark)
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    terms = F.transform("embedding", lambda x: x.cast("double") * scale)
    rows = rows.withColumn("is_query", F.coalesce(query & F.col("vec_id").isNotNull(), F.lit(False))).where(fine)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), "is_query", terms.alias("vector"))
    rows = written(rows, f"{folder}/rows")
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    term = F.array_position("vector", F.array_max("vector")).alias("term")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        ranged = rows.select("row", "id", "vector", term).repartitionByRange(-(-n // shard), "term", "id", "row").sortWithinPartitions("term", "id", "row")
        blocks = written(ranged.mapInArrow(_to_blocks, _BLOCKS), f"{folder}/blocks")
        chunks = written(rows.where("is_query").select("row", "id", "vector").repartition(-(-n_queries // chunk)).mapInArrow(_to_chunks, _CHUNKS), f"{folder}/chunks")
    n_shards, n_chunks = blocks.agg(F.max("shard") + 1).first()[0], chunks.agg(F.max("chunk") + 1).first()[0]

    def searched(chunks: DataFrame, first: bool) -> DataFrame:
        """Of each chunk, the unit with the shard of its own number, or all others."""
        own = lambda a, b, n: F.pmod(F.col(a), F.lit(n)) == F.pmod(F.col(b), F.lit(n))
        meets = own("chunk", "shard", n_shards) if first else ~own("chunk", "shard", n_shards)
        left = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<long>"))).where(meets)
        right = chunks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<long>"))).where(meets)
        return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(_unit(k), _FOUND)

    found = written(searched(chunks, True), f"{folder}/first")
    if n_shards > 1:
        full = found.groupBy("chunk", "query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        known = full.groupBy("chunk").agg(F.collect_list(F.struct("query_row", "least")).alias("known"))  # at most a chunk's queries
        found = found.unionByName(written(searched(chunks.join(known, "chunk", "left"), False), f"{folder}/rest"))
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

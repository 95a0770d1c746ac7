"""Operator 12: documents drawn by how much more their word runs are used in a target than in the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import located, on_workers, shared_dir, written

#: Words of one to so many make a feature; features fall into so many buckets.
LONGEST, BUCKETS = 3, 10_000
#: A-Z in lower case, and a space for each byte that no word has: words are of digits, letters and bytes beyond ASCII.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _parts(raw: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > size and (cut := raw.find(b" ", at + size)) >= 0:
        yield raw[at:cut]
        at = cut
    yield raw[at:] if at else raw


def word_runs(text: bytes, longest: int = LONGEST, size: int = 1 << 20) -> Iterator[list[list[int]]]:
    """CRC-32 of every run of 1 to longest words, joined by one space: for each part of the text, a list for each length.

    One scan: the ring holds a running state for each of the last starts, and a word extends each of them by a space
    and itself. States go on from part to part, so a part's size bounds the memory and changes no result. A part's
    states are extended together, length by length.
    """
    ring: list[int] = []  # ring[k]: the state of the k + 1 words up to the last one read
    for part in _parts(text.translate(_PLAIN), size):
        words = part.split()
        if not words:
            continue
        spaced, states, out, kept = [*map(b" ".__add__, words)], [*map(crc32, words)], [], []
        for k in range(longest):
            out.append(states)
            open_ = ring[k : k + 1] + states
            kept += open_[-1:]
            states = [*map(crc32, spaced[len(words) - len(open_) + 1 :], open_)] if open_ else []
        ring = kept
        yield out


def _buckets(text: bytes | None, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part: its number of words, and the bucket of each of its features."""
    for lists in word_runs(text or b"", longest):
        yield len(lists[0]), np.concatenate([np.array(s, np.int64) for s in lists]) % buckets


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends a row a bucket, and so many come to the driver."""
    on_workers(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, b in _buckets(text, longest, buckets):
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], schema=schema)

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1,000 times the log of its share in the target over that in the corpus, one added to each count, rounded down."""
    all_s, all_t, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = ((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """docs (doc_id, text, place) with n_words, n_features and weight, the sum of the gains of a text's features, in place of the text."""
    on_workers(docs.sparkSession)
    kinds = [("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = features = weight = 0
                for n, b in _buckets(text, longest, len(gain)):
                    words, features, weight = words + n, features + len(b), weight + int(gain[b].sum())
                rows.append((words, features, weight))
            cols = zip(*rows) if rows else [[]] * 3
            own = [batch.column("doc_id"), batch.column("place")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True))], names=["doc_id", "place", *(n for n, _ in kinds)])

    rows = docs.select("doc_id", "place", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, place struct<file: string, row: long>, n_words long, n_features long, weight long")


def noisy(weight: F.Column, doc_id: F.Column, seed: int) -> F.Column:
    """The weight with noise of the document's id that makes the highest ones a draw without replacement by e**(weight / 1000)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, order: list[F.Column], folder: str) -> DataFrame:
    """rows with rank, 1, 2, 3 and so on in the order, without a task that has them all.

    They are written in order, dealt by ranges; a row's rank is its number in its file and the rows of the files before.
    What is added up in one task and broadcast is a row a file, at most as many as there are shuffle partitions.
    """
    done = written(rows.orderBy(*order), folder)
    at = done.metadataColumn("_metadata")
    placed = done.select("*", at["file_name"].alias("_file"), at["row_index"].alias("_row"))
    number = lambda pattern: F.regexp_extract("_file", pattern, 1).cast("int")
    w = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\.")).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_file").count().select("_file", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_file").withColumn("rank", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank (null for those not drawn), n_words, place.

    Reads doc_id and text of docs and text of target, ignores other columns. A null or empty text, or one without a
    word, has no features and weight 0. Texts of any length are read in parts. Rows that repeat are documents of their own, and have one weight and noise;
    ties go by doc_id, a null doc_id is the greatest and counts as the empty text in the noise; rows that tie in all are ranked in any order. An empty target
    has no counts, an empty table gives no row. The draw is of percent of the rows with least_words words, rounded down.

    Two scans of the texts: counts by bucket, then weights. Only rows near the draw's end and above are put in order: a
    sketch names a score that leaves a little more than the draw, and a count proves it.
    """
    on_workers(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    return _ranked(located(docs, f"{folder}/rows"), target, folder, percent, least_words, longest, buckets, seed)


def _ranked(placed: DataFrame, target: DataFrame, folder: str, percent: int = 5, least_words: int = 20, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    placed = placed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "place")
    gain = gains(bucket_counts(placed, longest, buckets), bucket_counts(target, longest, buckets))
    rows = written(weighed(placed, gain, longest).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)), f"{folder}/weights")

    able = F.col("n_words") >= least_words
    near = max(0.0, 1 - percent / 100 - 0.002)
    n, edge, low = rows.where(able).agg(F.count("*"), F.percentile_approx("score", near, 10_000), F.min("score")).first()
    draw = percent * n // 100
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    if rows.where(able & (F.col("score") >= edge)).count() < draw:
        edge = low
    first = able & (F.col("score") >= edge)
    top = numbered(rows.where(first), [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")], f"{folder}/order")
    return top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rows.where(~first).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that resampled() draws, with all their columns."""
    on_workers(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    placed = located(docs, f"{folder}/rows")
    found = _ranked(placed, target, folder, **how).where("rank IS NOT NULL").select("place")
    return placed.join(written(found, f"{folder}/places"), "place", "left_semi").select("row.*")

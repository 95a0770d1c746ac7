"""Operator 7: near-duplicates by SimHash fingerprints, found with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import PLACE, kept_by_worker, located, looked_up, on_workers, segments, shared_dir, without, words, written

RADIUS = 2
#: Fingerprints that meet under one key of a segment table are paired with each other up to this number;
#: beyond it, all of them are linked through the one-bit balls of whole fingerprints, which finds the same links.
BUCKET = 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HIDDEN = 2**63 - 1


def _votes(shingles: Iterable[str], n: int) -> np.ndarray:
    raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(42)))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash over word shingles, as a signed 64-bit number."""
    votes, n, last = 0, 0, []
    for part in segments(text or ""):
        w = last + words(part.lower() if part.isascii() else part.translate(_LOWER))
        if len(w) >= size:
            m = len(w) - size + 1
            votes, n = votes + _votes(map(" ".join, zip(*(w[i:] for i in range(size)), strict=False)), m), n + m
            last = w[len(w) - size + 1 :]
        else:
            last = w
    if not n:
        if not last:
            return 0
        votes, n = _votes([" ".join(last)], 1), 1
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame) -> DataFrame:
    """doc_id, place and fp of rows as located() has them, in one pass without a shuffle."""
    on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(None, bool)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(map(fingerprint, batch.column("text").to_pylist()), pa.int64())], ["doc_id", "place", "fp"])

    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "place", F.col("row.text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, place {PLACE}, fp long")


def links(fps: DataFrame, folder: str, bucket: int = BUCKET) -> DataFrame:
    """a and b: a set of pairs of fingerprints at most 2 bits apart, with the same components as all such pairs.

    fps: fp long, distinct. Two segments of 32 bits. Of two fingerprints at most 2 bits apart, either the
    second segments are equal or the first are at most 1 bit apart. So the second table is asked for the key
    itself, the first for its one-bit ball; as of two keys one bit apart one has a bit set that the other
    hasn't, it is enough to clear each bit that is set.
    """
    hi = F.shiftrightunsigned("fp", 32)
    probe = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("getbit", hi, b) == 1), lambda b: F.struct(F.lit(0).alias("segment"), hi.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("key"), F.lit(True).alias("asks")))
    own = F.array(
        F.struct(F.lit(0).alias("segment"), hi.alias("key"), F.lit(False).alias("asks")),
        F.struct(F.lit(1).alias("segment"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), F.lit(False).alias("asks")),
    )
    table = fps.select("fp", F.inline(F.concat(own, probe))).withColumn("key", F.shiftleft("key", 1) + F.col("segment"))
    sizes = table.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("asks")).alias("there")).where("n > 1 AND there > 0").drop("there")
    met = written(looked_up(table, sizes, "key", "n", 34 * fps.count()).where("n > 1"), f"{folder}/met")
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    few = (
        met.where(F.col("n") <= bucket)
        .groupBy("key")
        .agg(F.collect_list(F.when(~F.col("asks"), F.col("fp"))).alias("there"), F.collect_list("fp").alias("all"))
        .select("all", F.explode("there").alias("a"))
        .select("a", F.explode(F.filter("all", lambda b: (b != F.col("a")) & (apart(b, F.col("a")) <= RADIUS))).alias("b"))
    )
    balls = (
        met.where(F.col("n") > bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))).alias("middle"))
        .groupBy("middle")
        .agg(F.array_sort(F.collect_list("fp")).alias("all"))  # at most 65 fingerprints are within a bit of one
        .where(F.size("all") > 1)
        .select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
        .where(apart(F.col("a"), F.col("b")) <= RADIUS)
    )
    return few.unionByName(balls).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that is reachable over links of at most 2 differing bits. Null
    texts and texts without a word have the fingerprint zero; equal fingerprints are linked at no cost, as
    one. A null doc_id counts as greater than any other; a component of null ids alone has a null id.
    Components may share their smallest doc_id, if it is null or repeated. Extra columns are ignored. No row, no result.
    """
    folder = shared_dir(docs.sparkSession)
    return _groups(located(docs, f"{folder}/rows"), folder, bucket)


def _groups(placed: DataFrame, folder: str, bucket: int = BUCKET, with_place: bool = False) -> DataFrame:
    rows = written(fingerprints(placed), f"{folder}/fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_HIDDEN))).alias("rank"), F.count("*").alias("n")), f"{folder}/distinct")
    linked = components(links(fps.select("fp"), folder, bucket), fps.select(F.col("fp").alias("node"), "rank"), folder)
    total = fps.agg(F.sum("n")).first()[0] or 0
    table = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("component", "rank").alias("component"), F.coalesce("root", "fp").alias("root"))
    return looked_up(rows, table, "fp", "n", total).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component") != _HIDDEN, F.col("component")).alias("component_id"),
        *(["place", "root"] if with_place else []),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all its columns; of repeated ids, the first by place.

    A null doc_id is the last of all, null and empty texts are one component, and so are repeated rows. Columns may have
    any names. Components are told apart by their root, a fingerprint, as their smallest doc_id may be null or repeated.
    """
    folder = shared_dir(docs.sparkSession)
    placed = located(docs, f"{folder}/rows")
    rows = written(_groups(placed, folder, with_place=True), f"{folder}/groups")
    first = rows.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_HIDDEN)), "place")).alias("first")).select("first.place")
    return without(placed, rows.select("place").join(first, "place", "left_anti"), f"{folder}/dropped")

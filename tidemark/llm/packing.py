"""Operator 1: harmonic packing of whole documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import on_workers
from tidemark.llm.tokens import VOCABULARY, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
WIDTH = 4


def cuts(n: int, capacity: int = 4096, slack: int = 4) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids, in order.

    Class k takes pieces longer than capacity // (k + 1) and no longer than capacity // k, so k of them
    fill a sequence. A piece that would leave more than slack unused in its slot is first cut at the next
    reciprocal length; what is left shrinks quadratically, so there are few pieces.
    """
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity // k - n > slack:
            size = capacity // (k + 1)
            out.append((size, capacity // size))
            n -= size
        else:
            out.append((n, k))
            n = 0
    return out


class HarmonicPacker:
    """One worker's bins. A class's bin is closed when it has the class's number of pieces, and no bin
    depends on another worker. At most one bin a class is open, so memory is bounded by the classes."""

    def __init__(self, capacity: int, slack: int):
        self.capacity, self.slack, self.open = capacity, slack, {}

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        """Yields the sequences that this document fills, as lists of (doc_id, start, ids, doc_tokens)."""
        n, start = len(ids) // WIDTH, 0
        for size, k in cuts(n, self.capacity, self.slack):
            piece = (doc_id, start, ids[start * WIDTH : (start + size) * WIDTH], n)
            start += size
            if k == 1:
                yield [piece]
                continue
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list[tuple]]:
        """The bins still open, run together: full sequences, then one for each power of two of the rest."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest) // WIDTH
        sizes = [self.capacity] * (left // self.capacity)
        left %= self.capacity
        sizes += [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        at, used = 0, 0
        for size in sizes:
            out = []
            while size:
                doc_id, start, ids, n = rest[at]
                take = min(size, len(ids) // WIDTH - used)
                out.append((doc_id, start + used, ids[used * WIDTH : (used + take) * WIDTH], n))
                size, used = size - take, used + take
                if used * WIDTH == len(ids):
                    at, used = at + 1, 0
            yield out


def _rows(sequences: Iterator[list[tuple]], first: int) -> Iterator[tuple]:
    for at, sequence in enumerate(sequences, first):
        offset = 0
        for doc_id, start, ids, n in sequence:
            yield doc_id, start, len(ids) // WIDTH, zlib.crc32(ids), n, at, offset
            offset += len(ids) // WIDTH


def pack(docs: DataFrame, capacity: int = 4096, slack: int = 4, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs every document into sequences of at most capacity ids; one row a piece.

    Reads doc_id and text, ignores other columns. A null or empty text is its end id alone; a null doc_id
    stays null; repeated rows are packed each. No row, no result. Every id is in exactly one piece. Each
    task packs alone, without a shuffle: classes of reciprocal capacity are filled by count, and what is
    left in open bins at the end of the task is run together and cut, the last part at powers of two,
    which take no padding. sequence_id has the task in its upper bits.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = encoder(vocabulary), HarmonicPacker(capacity, slack)
        end, at, rows = end_id.to_bytes(WIDTH, "little"), TaskContext.get().partitionId() << 40, []
        schema = pa.schema([(n, pa.int64()) for n in NAMES])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(NAMES))], schema=schema)
        for batch in batches:
            texts = (x or "" for x in batch.column("text").to_pylist())
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), ids.encode(texts), strict=True):
                for row in _rows(packer.add(doc_id, got + end), at):
                    rows.append(row)
                    at = row[5] + 1
                if len(rows) > 20_000:
                    yield flush()
                    rows = []
        rows.extend(_rows(packer.close(), at))
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

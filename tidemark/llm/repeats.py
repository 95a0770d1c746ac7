"""Operator 6: removal of repeated passages, by bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import FAN, SCHEMA, bundled, delivered, forgotten, received, sent, table, unbundled
from tidemark.llm.shared import cleaned_shuffles, kept_by_worker, located, on_workers, shared_dir, written

#: Bytes of a passage that counts.
LENGTH = 50
#: Bytes of the pieces of a passage that are hashed; the least hash is the passage's key.
PIECE = 24
#: Bytes of text in a block, and about as many in an index.
BLOCK = 8_000_000
INDEX = 1_500_000
#: A key that stands in more documents than this is hot: its passages are dealt out one by one.
HOT = 10_000
#: Doesn't occur in UTF-8; stands between strings in an index.
GAP = 0xFF
_LAST = 2**63 - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEY_BITS = 48


# Keys


def _eights(b: np.ndarray) -> np.ndarray:
    """Each 8 bytes in a row as a number."""
    x = b.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | x[s:] << np.uint64(8 * s)
    return x


def _keys(b: np.ndarray) -> np.ndarray:
    """A key of each 50 bytes in a row: the least hash of the 24-byte pieces in them."""
    e, n = _eights(b), len(b) - PIECE + 1
    with np.errstate(over="ignore"):
        h = e[:n] * _A
        h = (h ^ h >> np.uint64(29)) + e[8 : 8 + n] * _B
        h = (h ^ h >> np.uint64(31)) * _A + e[16 : 16 + n] * _C
        h = (h ^ h >> np.uint64(32)) * _B >> np.uint64(64 - _KEY_BITS)
    wide, s = LENGTH - PIECE + 1, 1
    while 2 * s <= wide:
        h, s = np.minimum(h[:-s], h[s:]), 2 * s
    return np.minimum(h[: len(b) - LENGTH + 1], h[wide - s : wide - s + len(b) - LENGTH + 1])


def runs(b: np.ndarray, part: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, start and size of the runs of passages (by where they start) that have the same key."""
    n = len(b) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, starts = [], []
    for at in range(0, n, part):
        m = _keys(b[at : at + part + LENGTH - 1])
        new = np.flatnonzero(np.r_[not keys or keys[-1][-1] != m[0], m[1:] != m[:-1]])
        if len(new):
            keys.append(m[new])
            starts.append(new + at)
    start = np.concatenate(starts)
    return np.concatenate(keys), start, np.diff(np.r_[start, n])


class Block:
    """The documents of a block in the order of doc_id, and the runs of all of them."""

    def __init__(self, texts: pa.Table):
        rows = [(_LAST if d is None else d, t.encode()) for d, t in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True)]
        rows.sort()
        self.ids, self.texts = np.array([d for d, _ in rows], np.int64), [t for _, t in rows]
        each = [runs(np.frombuffer(t, np.uint8)) for t in self.texts]
        self.of = np.repeat(np.arange(len(each)), [len(k) for k, *_ in each])
        self.key, self.start, self.size = (np.concatenate([e[i] for e in each]) if each else np.zeros(0, np.int64) for i in range(3))
        self.distinct, self.at = np.unique(self.key, return_inverse=True)

    def documents(self) -> np.ndarray:
        """In how many documents each distinct key stands."""
        order = np.lexsort((self.of, self.at))
        at, of = self.at[order], self.of[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])] if len(at) else np.zeros(0, bool)
        return np.bincount(at[new], minlength=len(self.distinct))

    def strings(self, flags: np.ndarray) -> tuple[dict[bytes, int], list[int], list[int], list[tuple[int, int, int]]]:
        """What is looked for elsewhere: distinct strings and their numbers, their keys, the smallest doc_id of each, and
        (document, start, string) of all occurrences.

        A run of a shared key is one string, all its passages; passages of a hot key are strings of their own,
        keyed by a hash of the whole.
        """
        numbers: dict[bytes, int] = {}
        keys, first, there = [], [], []
        flag = flags[self.at]
        for i in np.flatnonzero(flag == 1).tolist():
            of, at = int(self.of[i]), int(self.start[i])
            s = self.texts[of][at : at + int(self.size[i]) + LENGTH - 1]
            n = numbers.setdefault(s, len(keys))
            if n == len(keys):
                keys.append(int(self.key[i]))
                first.append(int(self.ids[of]))
            there.append((of, at, n))
        for i in np.flatnonzero(flag == 2).tolist():
            of, text = int(self.of[i]), self.texts[int(self.of[i])]
            for at in range(int(self.start[i]), int(self.start[i] + self.size[i])):
                s = text[at : at + LENGTH]
                n = numbers.setdefault(s, len(keys))
                if n == len(keys):
                    keys.append(int.from_bytes(hashlib.blake2b(s, digest_size=_KEY_BITS // 8).digest(), "little"))
                    first.append(int(self.ids[of]))
                there.append((of, at, n))
        return numbers, keys, first, there


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by bucket, and (bucket, from, to) in this order; of no key, none."""
    with np.errstate(over="ignore"):
        bucket = ((keys.astype(np.uint64) * _C >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return order, [*zip(found.tolist(), begin.tolist(), np.r_[begin, len(keys)][1:].tolist(), strict=True)]


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, _KEY_BITS // 8)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, : b.shape[1]] = b
    return out.reshape(-1).view("<u8")


# The index


def _sorted(text: np.ndarray, depth: int) -> np.ndarray:
    """The starts of the suffixes in order of at least their first depth bytes, by doubling; equal ones in any order."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, GAP, np.uint8)])
    key = _eights(padded)[:n].byteswap()
    size = 8
    while True:
        order = np.argsort(key)
        in_order = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, in_order[1:] != in_order[:-1]])
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.concatenate([rank[size:], np.full(min(size, n), rank[-1])])
        key = (rank << 32 | after).view(np.uint64)
        size *= 2


def intervals(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the suffixes in order, and where in this order an interval of equal first `length` bytes begins.

    Breadth-first over depths. At depth d, marks delimit the intervals of suffixes that share d bytes. The
    transform holds the byte before each suffix; those of a byte, in order, are the suffixes that begin with
    it. So two neighbours there share d + 1 bytes if and only if what they extend backwards lay in one
    interval of depth d: if not, their common prefix is d, and the mark is set. Common prefixes are thus found
    by increasing value, each once, and none that reaches `length` is looked into further.
    """
    order = _sorted(text, length)
    before = text[order - 1]  # of the first suffix it is the last byte, a gap
    back = np.argsort(before, kind="stable")
    begins = before[back]
    mark = np.r_[True, begins[1:] != begins[:-1]]  # depth 1
    open_ = np.flatnonzero(~mark)
    right, left = back[open_], back[open_ - 1]
    for _ in range(length - 1):
        if not len(open_):
            break
        interval = np.cumsum(mark, dtype=np.int32)
        split = interval[right] != interval[left]
        mark[open_[split]] = True
        open_, right, left = open_[~split], right[~split], left[~split]
    return order, mark


def first_seen(strings: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each passage of each string in a row: the smallest of docs, one a string, among strings that have it.

    Strings have at least 50 bytes.
    """
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    ends = np.cumsum(sizes + 1)
    order, mark = intervals(text)
    passage = (ends[string] - 1 - np.arange(len(text)) >= LENGTH)[order]
    doc = np.where(passage, docs[string[order]], _LAST)
    begin = np.flatnonzero(mark)
    least = np.empty(len(text), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.r_[begin, len(text)]))
    return least[ends[string] - 1 - np.arange(len(text)) >= LENGTH]


def period(s: bytes) -> int:
    """The period of a long string that repeats itself from end to end, found by where its first passage stands again; else 0."""
    p = s.find(s[:LENGTH], 1) if len(s) > 4 * LENGTH else 0
    return p if p > 0 and s[p:] == s[: len(s) - p] else 0


def earlier(strings: list[bytes], docs: np.ndarray, keys: np.ndarray, index: int = INDEX) -> np.ndarray:
    """For each passage of each distinct string: whether a string of a smaller doc has it.

    Only strings under one key can share a passage. Strings alone under their key go into no index; the
    others are indexed in parts by key of about `index` bytes. Of one that repeats itself from end to end, as rules and
    padding do, its first passages up to the period are all that differ, and all that is indexed.
    """
    n = np.array([len(s) - LENGTH + 1 for s in strings])
    out = np.zeros(int(n.sum()), bool)
    begin = np.cumsum(n) - n
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[at] > 1)
    if not len(several):
        return out
    rank = np.cumsum(count > 1)[at[several]] - 1
    periods = np.array([period(strings[i]) for i in several.tolist()])
    own_n = np.where(periods > 0, periods, n[several])  # passages that are indexed
    volume = np.bincount(rank, weights=own_n + LENGTH)
    part = (np.cumsum(volume) // index).astype(int)[rank]
    for p in np.unique(part):
        own, m = several[part == p], own_n[part == p]
        least = first_seen([strings[i][: k + LENGTH - 1] for i, k in zip(own.tolist(), m.tolist(), strict=True)], docs[own])
        flags, at_cut = least < np.repeat(docs[own], m), np.cumsum(m) - m
        whole = np.repeat(m == n[own], m)
        places = np.repeat(begin[own] - at_cut, m) + np.arange(len(flags))
        out[places[whole]] = flags[whole]
        for i in np.flatnonzero(m < n[own]).tolist():  # passages that come again and again
            out[begin[own[i]] : begin[own[i]] + n[own[i]]] = np.resize(flags[at_cut[i] : at_cut[i] + m[i]], n[own[i]])
    return out


# The passes


def _send_keys(texts: pa.Table, buckets: int, fan: int) -> Iterator[dict]:
    kept_by_worker(None, bool)
    block = Block(texts)
    order, parts = _dealt(block.distinct, buckets)
    count = block.documents()[order].astype("<u4")
    keys, at = block.distinct[order], texts.column("block")[0].as_py()
    return sent(at, ((at, bucket, bundled(_packed(keys[a:b]), count[a:b].tobytes())) for bucket, a, b in parts), fan)


def _flag_keys(rows: pa.Table, hot: int, fan: int) -> Iterator[dict]:
    got = [(block, *unbundled(m, 2)) for block, _, m in received(rows)]
    keys = [_unpacked(k) for _, k, _ in got]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([np.frombuffer(n, "<u4") for *_, n in got]))
    flag = ((total > 1).astype(np.uint8) + (total > hot))[at].astype(np.uint8)
    ends, bucket = np.cumsum([len(k) for k in keys]), rows.column("node")[0].as_py()
    return sent(bucket, ((bucket, block, flag[end - len(k) : end].tobytes()) for (block, *_), k, end in zip(got, keys, ends.tolist(), strict=True)), fan)


def _flags(block: Block, answers: pa.Table, buckets: int) -> np.ndarray:
    got = {bucket: m for bucket, _, m in received(answers)}
    order, parts = _dealt(block.distinct, buckets)
    out = np.zeros(len(block.distinct), np.uint8)
    for bucket, a, b in parts:
        out[order[a:b]] = np.frombuffer(got[bucket], np.uint8)
    return out


def _send_strings(texts: pa.Table, answers: pa.Table, buckets: int, fan: int) -> Iterator[dict]:
    block = Block(texts)
    numbers, keys, first, _ = block.strings(_flags(block, answers, buckets))
    strings, keys, first = [*numbers], np.array(keys, np.uint64), np.array(first, "<i8")
    order, parts = _dealt(keys, buckets)
    packer, at = zstandard.ZstdCompressor(1), texts.column("block")[0].as_py()

    def message(own: np.ndarray) -> bytes:
        some = [strings[i] for i in own.tolist()]
        sizes = np.array([len(s) for s in some], "<u4").tobytes()
        return bundled(_packed(keys[own]), first[own].view(np.uint8).reshape(-1, 8).T.tobytes(), sizes, packer.compress(b"".join(some)))

    return sent(at, ((at, bucket, message(order[a:b])) for bucket, a, b in parts), fan)


def _match(rows: pa.Table, index: int, fan: int) -> Iterator[dict]:
    numbers: dict[bytes, int] = {}
    all_keys, least, answers = [], [], []
    for block, _, m in received(rows):
        packed, docs, sizes, raw = unbundled(m, 4)
        docs = np.frombuffer(docs, np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1)
        at, of, raw = 0, [], zstandard.decompress(raw)
        for size, key, doc in zip(np.frombuffer(sizes, "<u4").tolist(), _unpacked(packed).tolist(), docs.tolist(), strict=True):
            s = raw[at : at + size]
            at += size
            n = numbers.setdefault(s, len(all_keys))
            if n == len(all_keys):
                all_keys.append(key)
                least.append(doc)
            elif doc < least[n]:
                least[n] = doc
            of.append(n)
        answers.append((block, np.array(of), docs))
    strings, least = [*numbers], np.array(least, np.int64)
    found = earlier(strings, least, np.array(all_keys, np.uint64), index)
    n = np.array([len(s) - LENGTH + 1 for s in strings])
    begin, bucket = np.cumsum(n) - n, rows.column("node")[0].as_py()

    def message(of: np.ndarray, docs: np.ndarray) -> bytes:
        size = n[of]
        bits = found[np.repeat(begin[of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return np.packbits(bits | np.repeat(docs > least[of], size)).tobytes()

    return sent(bucket, ((bucket, block, message(of, docs)) for block, of, docs in answers), fan)


def cut(text: bytes, gone: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text without all bytes of the passages that start where gone is true, how many bytes go and in how many runs."""
    edge = np.zeros(len(text) + 1, np.int64)
    edge[: len(gone)] += gone
    edge[LENGTH : LENGTH + len(gone)] -= gone
    cover = np.cumsum(edge[:-1]) > 0
    spans = int((cover[1:] & ~cover[:-1]).sum() + cover[:1].sum())
    return np.frombuffer(text, np.uint8)[~cover].tobytes(), int(cover.sum()), spans


def _apply(texts: pa.Table, answers: pa.Table, buckets: int, with_text: bool = False) -> Iterator[dict]:
    block = Block(texts)
    bits_of = answers.column("bits").to_numpy(zero_copy_only=False).astype(bool)
    numbers, keys, first, there = block.strings(_flags(block, answers.filter(pa.array(~bits_of)), buckets))
    got = {bucket: m for bucket, _, m in received(answers.filter(pa.array(bits_of)))}
    size = np.array([len(s) - LENGTH + 1 for s in numbers], np.int64)
    order, parts = _dealt(np.array(keys, np.uint64), buckets)
    flat = [np.unpackbits(np.frombuffer(got[bucket], np.uint8), count=int(size[order[a:b]].sum())) for bucket, a, b in parts]
    bits = np.concatenate(flat).astype(bool) if flat else np.zeros(0, bool)
    begin = np.zeros(len(size), np.int64)
    begin[order] = np.cumsum(size[order]) - size[order]
    some = np.zeros(len(size), bool)
    if len(size):
        some[order] = np.logical_or.reduceat(bits, begin[order])
    of, at, n = np.array(there, np.int64).reshape(-1, 3).T
    later = block.ids[of] > np.array(first, np.int64)[n]
    gone: dict[int, np.ndarray] = {}
    for i in np.flatnonzero(later | some[n]).tolist():
        d, start, k = int(of[i]), int(at[i]), int(n[i])
        marks = gone.get(d)
        if marks is None:
            marks = gone[d] = np.zeros(len(block.texts[d]) - LENGTH + 1, bool)
        if later[i]:
            marks[start : start + size[k]] = True
        else:
            marks[start : start + size[k]] |= bits[begin[k] : begin[k] + size[k]]
    for i, (doc_id, text) in enumerate(zip(block.ids.tolist(), block.texts, strict=True)):
        left, lost, spans = cut(text, gone[i]) if i in gone else (text, 0, 0)
        row = {"doc_id": None if doc_id == _LAST else doc_id, "n_bytes": len(text), "n_removed": lost, "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()}
        yield row | {"kept": left} if with_text else row


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def without_repeats(docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK, index: int = INDEX, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes left, if asked for.

    Each byte goes that a 50-byte string covers which also starts in a document with a smaller doc_id. A null
    text is empty and shorter texts lose nothing; a null doc_id counts as greater than all others; rows with
    the same doc_id take nothing from each other. Extra columns are ignored. No row, no result.

    Documents are dealt to blocks. Equal passages have equal keys, the least hash of their pieces. First, each
    block sends its distinct keys, and learns which stand in several documents of any block. Then it sends the
    runs of passages under such keys, each distinct string once and with its smallest doc_id, to where all
    strings of the key meet; there an index finds which passages stand in strings of smaller ids. Passages
    of a key in very many documents are dealt out one by one, so no group is larger than the blocks are many
    or than the limit. Last, each block applies the answers.
    """
    spark = docs.sparkSession
    on_workers(spark)
    folder = shared_dir(spark)
    placed = located(docs, f"{folder}/rows")
    doc_id, text = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    size = placed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    # the place spreads rows that repeat id and text, and is the same whenever the table is read
    dealt = placed.select(doc_id.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc_id, text, "place.file", "place.row"), F.lit(n)).alias("block"))
    result = _RESULT + (", kept binary" if with_text else "")
    result_schema = _arrow(result)

    with cleaned_shuffles(spark):
        keys = delivered(dealt.groupBy("block").applyInArrow(lambda t: table(_send_keys(t, n, fan)), SCHEMA), n, f"{folder}/keys", fan)
        flags = delivered(keys.groupBy("node").applyInArrow(lambda t: table(_flag_keys(t, hot, fan)), SCHEMA), n, f"{folder}/flags", fan)
        forgotten(spark, f"{folder}/keys")
        strings = dealt.groupBy("block").cogroup(flags.groupBy("node")).applyInArrow(lambda t, a: table(_send_strings(t, a, n, fan) if len(t) else []), SCHEMA)
        strings = delivered(strings, n, f"{folder}/strings", fan)
        matches = delivered(strings.groupBy("node").applyInArrow(lambda t: table(_match(t, index, fan)), SCHEMA), n, f"{folder}/matches", fan)
        forgotten(spark, f"{folder}/strings")
        answers = flags.withColumn("bits", F.lit(False)).unionByName(matches.withColumn("bits", F.lit(True)))
        out = dealt.groupBy("block").cogroup(answers.groupBy("node")).applyInArrow(lambda t, a: table(_apply(t, a, n, with_text) if len(t) else [], result_schema), result)
        out = written(out, f"{folder}/result")
        for kind in ("flags", "matches"):
            forgotten(spark, f"{folder}/{kind}")
        return out

"""Operator 13: phrases that stand together more often than their parts would, mined by position bitmaps of words."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exchange import bundled, delivered, forgotten, received, sent, table, unbundled
from tidemark.llm.exchange import SCHEMA as LETTERS
from tidemark.llm.shared import WIDE_ROWS, cleaned_shuffles, located, on_workers, shared_dir, written

#: Bytes of text in a shard, and of a text that is cut at its pieces before it is dealt out.
BLOCK, LONG = 5_000_000, 2_000_000
#: Messages go in one step among up to so many shards; shards are small, as their words and phrases are all that is in memory.
FAN = 256
#: Entries of first words' bitmaps that are extended at once, to bound the memory.
AT_ONCE = 1 << 17
_ENDS = r"[.,;:!?\x0A-\x0D]"
#: A-Z in lower case, one sign for each end of a piece, a space for a tab.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c for c in range(256))


class _Numbers(dict):
    """Numbers for the words of a language, from a count that all languages share; 0 is the end of a piece."""

    def __init__(self, count: Iterator[int]):
        super().__init__({b"\n": 0})
        self.count = count

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.count)
        return n


def read_words(texts: Iterator[tuple[str, bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """The words of (language, text) in a row as numbers, 0 after each piece, and each number's word with its language."""
    count, of, parts = itertools.count(1), {}, []
    for lang, text in texts:
        numbers = of.get(lang)
        if numbers is None:
            numbers = of[lang] = _Numbers(count)
        tokens = (text.translate(_PLAIN).replace(b"\n", b" \n ") + b" \n").split(b" ")
        parts.append(np.array([numbers[w] for w in tokens if w], "<u4"))
    names = [b""] * next(count)
    for lang, numbers in of.items():
        tag = b" " + quote(lang, safe="").encode()
        for w, n in numbers.items():
            if n:
                names[n] = w + tag
    return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), names


class Bitmaps:
    """Compressed bitmaps of positions: entries (number, chunk, bits), one for each chunk of eight positions that isn't empty."""

    def __init__(self, numbers: np.ndarray):
        """numbers: at each position a word's number, or below 0 for none."""
        at = np.flatnonzero(numbers >= 0)
        at = at[np.argsort(numbers[at], kind="stable")]
        number, chunk = numbers[at], at >> 3
        first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (chunk[1:] != chunk[:-1])]) if len(at) else at
        self.number, self.chunk = number[first], chunk[first]
        self.bits = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(at) else np.zeros(0, np.uint8)
        self.by_chunk = np.argsort(self.chunk, kind="stable")
        self.begin = np.r_[0, np.bincount(self.chunk, minlength=(len(numbers) >> 3) + 2).cumsum()]

    def groups(self) -> Iterator[slice]:
        """Entries of first words, some words at a time, a word's all in one."""
        at, n = 0, len(self.number)
        while at < n:
            to = at + AT_ONCE
            to = n if to >= n else int(np.searchsorted(self.number, self.number[to], "left" if self.number[to] != self.number[at] else "right"))
            yield slice(at, to)
            at = to

    def extended(self, number: np.ndarray, chunk: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps of each number shifted by one position and ANDed with each word's: number, word, chunk and bits where any are left."""
        wide = bits.astype(np.uint16) << 1
        low, over = np.flatnonzero(wide & 255), np.flatnonzero(wide >> 8)
        number, chunk = np.r_[number[low], number[over]], np.r_[chunk[low], chunk[over] + 1]
        bits = np.r_[wide[low] & 255, np.ones(len(over), np.uint16)].astype(np.uint8)
        many = self.begin[chunk + 1] - self.begin[chunk]
        mine = np.repeat(np.arange(len(chunk)), many)
        other = self.by_chunk[np.arange(len(mine)) + np.repeat(self.begin[chunk] - (many.cumsum() - many), many)]
        both = bits[mine] & self.bits[other]
        kept = np.flatnonzero(both)
        mine, other = mine[kept], other[kept]
        return number[mine], self.number[other], chunk[mine], both[kept]


class Level:
    """The phrases of a length that are frequent everywhere and stand in a shard, numbered in the order of their words.

    words: a row of word numbers each. key: the number of the phrase without its last word, times the number of words,
    plus that word. tail: the number of the phrase without its first word. f: how often it occurs in all shards.
    """

    def __init__(self, words: np.ndarray, key: np.ndarray, tail: np.ndarray, f: np.ndarray, own: np.ndarray):
        order = np.argsort(key)
        self.words, self.key, self.tail, self.f, self.own = words[order], key[order], tail[order], f[order], own[order]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for those that aren't there."""
        at = np.searchsorted(self.key, key)
        return np.where(np.append(self.key, -(2**63))[at] == key, at, -1)


class Shard:
    """A shard's words and what is known of its phrases from the answers so far."""

    def __init__(self, names: list[bytes], answers: pa.Table, buckets: int, known: int):
        """answers: rows of LETTERS with level, up to the known one; those of level 1 to words, by their places among those sent to a bucket."""
        lists = _dealt(names, buckets)
        got = {k: received(answers.filter(pc.equal(answers.column("level"), k))) for k in range(1, known + 1)}
        found = [np.zeros((0, 3), np.int64)]
        for bucket, _, m in got[1]:
            place, ids, f = unbundled(m, 3)
            local = np.array(lists[bucket])[np.frombuffer(place, "<u4")]
            found.append(np.stack([local, np.frombuffer(ids, "<i8"), np.frombuffer(f, "<i8")], 1))
        frequent = np.concatenate(found)
        frequent = frequent[np.argsort(frequent[:, 0])]
        self.local, self.ids, self.size = frequent[:, 0], frequent[:, 1], len(frequent)
        self.by_id = np.argsort(self.ids)
        number, none = np.arange(self.size), np.zeros(self.size, np.int64)
        self.levels = {1: Level(number[:, None], number, none, frequent[:, 2], none.astype(bool))}
        for level in range(2, known + 1):
            rows, f, own = [np.zeros((0, level), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for *_, m in got[level]:
                some, n, mine = unbundled(m, 3)
                rows.append(np.frombuffer(some, "<i8").reshape(-1, level))
                f.append(np.frombuffer(n, "<i8"))
                own.append(np.frombuffer(mine, bool))
            words = self.by_id[np.searchsorted(self.ids, np.concatenate(rows), sorter=self.by_id)] if self.size else np.concatenate(rows)
            self.levels[level] = Level(words, self.numbered(words[:, :-1]) * self.size + words[:, -1], self.numbered(words[:, 1:]), np.concatenate(f), np.concatenate(own))

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """The numbers of frequent phrases, of one length, from their words."""
        at = words[:, 0]
        for k in range(1, words.shape[1]):
            at = self.levels[k + 1].find(at * self.size + words[:, k])
        return at

    def counted(self, seq: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of a length whose parts are all frequent, as rows of word numbers, and how often each stands in the shard.

        Depth first: some first words' bitmaps are extended word by word to the length, then the next ones'. What isn't
        frequent everywhere is left as soon as its length is known.
        """
        of = np.full(int(seq.max(initial=0)) + 1, -1, np.int64)
        of[self.local] = np.arange(self.size)
        maps, above = Bitmaps(of[seq]), self.levels[length - 1]
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in maps.groups():
            number, chunk, bits = maps.number[some], maps.chunk[some], maps.bits[some]
            for k in range(2, length + 1):
                number, word, chunk, bits = maps.extended(number, chunk, bits)
                key = number * self.size + word
                if k < length:
                    number = self.levels[k].find(key)
                    kept = np.flatnonzero(number >= 0)
                    number, chunk, bits = number[kept], chunk[kept], bits[kept]
            if length > 2:
                kept = np.flatnonzero(above.find(above.tail[number] * self.size + word) >= 0)
                key, bits = key[kept], bits[kept]
            order = np.argsort(key, kind="stable")
            key, n = key[order], np.bitwise_count(bits[order]).astype(np.int64)
            if len(key):
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                keys.append(key[first])
                counts.append(np.add.reduceat(n, first))
        key = np.concatenate(keys)
        number, word = np.divmod(key, max(1, self.size))
        return np.concatenate([above.words[number], word[:, None]], 1), np.concatenate(counts)

    def told(self, names: list[bytes]) -> Iterator[tuple]:
        """lang, phrase, ids, a, l, r, score of the phrases that are this shard's to tell."""
        for length, level in self.levels.items():
            mine = np.flatnonzero(level.own)
            if length == 1 or not len(mine):
                continue
            words, a, cuts = level.words[mine], level.f[mine], []
            for k in range(1, length):
                cuts.append((self.levels[k].f[self.numbered(words[:, :k])].tolist(), self.levels[length - k].f[self.numbered(words[:, k:])].tolist()))
            for i, (n, ids) in enumerate(zip(a.tolist(), self.ids[words].tolist(), strict=True)):
                score, _, left, right = min((1_000_000 * n * n // (x[i] * y[i]), k, x[i], y[i]) for k, (x, y) in enumerate(cuts))
                parts = [names[self.local[w]].rpartition(b" ") for w in words[i]]
                yield unquote(parts[0][2].decode()), b" ".join(p[0] for p in parts).decode(errors="replace"), ids, n, left, right, score


def _dealt(names: list[bytes], buckets: int) -> dict[int, list[int]]:
    """The numbers of words by bucket."""
    out: dict[int, list[int]] = {}
    for n, name in enumerate(names[1:], 1):
        out.setdefault(zlib.crc32(name) % buckets, []).append(n)
    return out


_INDEX = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("langs", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))])
_INDEX_SQL = "block long, words binary, names binary, counts binary, langs array<struct<lang: string, n: long>>"
_CANDIDATES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("ids", pa.list_(pa.int64())), *((n, pa.int64()) for n in ("a", "l", "r", "score"))])
_CANDIDATES_SQL = "lang string, phrase string, ids array<long>, a long, l long, r long, score long"


def _indexed(t: pa.Table) -> pa.Table:
    """A shard's row: its words in order, their names and counts, and the number of words by language."""
    seq, names = read_words(zip(t.column("lang").to_pylist(), t.column("text").to_pylist(), strict=True))
    counts, langs = np.bincount(seq, minlength=len(names)), Counter()
    for name, n in zip(names[1:], counts[1:].tolist(), strict=True):
        langs[name.rpartition(b" ")[2]] += n
    row = {"block": t.column("block")[0].as_py(), "words": zlib.compress(seq.tobytes(), 1), "names": zlib.compress(b"\n".join(names), 1), "counts": counts.astype("<u4").tobytes()}
    return table([row | {"langs": [{"lang": unquote(x.decode()), "n": n} for x, n in langs.items()]}], _INDEX)


def _sent_words(buckets: int, fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counts of each shard's words, to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                names, counts, block = _names(one), np.frombuffer(one.column("counts")[0].as_py(), "<u4"), one.column("block")[0].as_py()
                messages = ((block, b, bundled(b"\n".join([names[i] for i in own]), counts[own].tobytes())) for b, own in _dealt(names, buckets).items())
                yield from table(sent(block, messages, fan)).to_batches()

    return run


def _names(index: pa.Table | pa.RecordBatch) -> list[bytes]:
    return zlib.decompress(index.column("names")[0].as_py()).split(b"\n")


def _answered_words(least: int, buckets: int, fan: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket adds up its words' counts, gives the frequent ones ids, and tells each shard those that it sent."""

    def run(t: pa.Table) -> pa.Table:
        bucket, taken, total = t.column("node")[0].as_py(), [], Counter()
        for block, _, m in received(t):
            some, n = unbundled(m, 2)
            some = bytes(some).split(b"\n")
            taken.append((block, some))
            for w, c in zip(some, np.frombuffer(n, "<u4").tolist(), strict=True):
                total[w] += c
        ids = {w: i * buckets + bucket for i, w in enumerate(sorted(w for w, n in total.items() if n >= least))}

        def message(some: list[bytes]) -> bytes:
            at = [i for i, w in enumerate(some) if w in ids]
            return bundled(np.array(at, "<u4").tobytes(), np.array([ids[some[i]] for i in at], "<i8").tobytes(), np.array([total[some[i]] for i in at], "<i8").tobytes())

        return table(sent(bucket, ((bucket, block, message(some)) for block, some in taken), fan))

    return run


def _sent_phrases(length: int, buckets: int, fan: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A shard's phrases of a length with their counts, to the buckets of their ids."""

    def run(index: pa.Table, answers: pa.Table) -> pa.Table:
        if not index.num_rows:
            return table([])
        shard = Shard(_names(index), answers, buckets, length - 1)
        words, counts = shard.counted(np.frombuffer(zlib.decompress(index.column("words")[0].as_py()), "<u4"), length)
        if not len(words):
            return table([])
        ids, mixed = shard.ids[words], np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                mixed = (mixed ^ ids[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        of = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        found, begin = np.unique(of[order], return_index=True)
        block = index.column("block")[0].as_py()
        messages = ((block, int(b), bundled(ids[own].astype("<i8").tobytes(), counts[own].astype("<u4").tobytes())) for b, own in zip(found, np.split(order, begin[1:]), strict=True))
        return table(sent(block, messages, fan))

    return run


def _answered_phrases(length: int, least: int, last: bool, fan: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket adds up its phrases' counts and tells the frequent ones: each shard those that it sent, and which of them are
    its own to tell, as it is the first that sent them. Of the last length only these."""

    def run(t: pa.Table) -> pa.Table:
        bucket, blocks, rows, counts = t.column("node")[0].as_py(), [], [], []
        for block, _, m in received(t):
            some, n = unbundled(m, 2)
            rows.append(np.frombuffer(some, "<i8").reshape(-1, length))
            counts.append(np.frombuffer(n, "<u4").astype(np.int64))
            blocks.append(block)
        if not rows:
            return table([])
        cuts, rows, counts = np.cumsum([len(r) for r in rows])[:-1], np.concatenate(rows), np.concatenate(counts)
        order = np.lexsort(rows.T[::-1])  # stable: of equal phrases the first that was sent comes first
        new = np.r_[True, (rows[order][1:] != rows[order][:-1]).any(1)]
        total, own = np.empty(len(rows), np.int64), np.empty(len(rows), bool)
        total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[new.cumsum() - 1]
        own[order] = new
        kept = (total >= least) & (own if last else True)
        out = []
        for block, r, f, o, k in zip(blocks, np.split(rows, cuts), np.split(total, cuts), np.split(own, cuts), np.split(kept, cuts), strict=True):
            if k.any():
                out.append((bucket, block, bundled(r[k].tobytes(), f[k].tobytes(), o[k].tobytes())))
        return table(sent(bucket, out, fan))

    return run


def _told(longest: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(index: pa.Table, answers: pa.Table) -> pa.Table:
        if not index.num_rows:
            return pa.Table.from_pylist([], _CANDIDATES)
        names = _names(index)
        cols = [*zip(*Shard(names, answers, buckets, longest).told(names), strict=True)] or [[]] * len(_CANDIDATES)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _CANDIDATES, strict=True)], schema=_CANDIDATES)

    return run


def candidates(docs: DataFrame, longest: int = 3, least: int = 10, block_bytes: int = BLOCK, long_text: int = LONG, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to longest words that occur at least so often: lang, phrase, ids (of its words), a, l, r, score; and each lang with its number of words, n.

    Texts are dealt to shards, which index their words' positions. By length, each shard counts the phrases whose parts are
    frequent everywhere, sends each once to a bucket of its ids, and learns which are frequent. A bucket's size is that of
    a shard, however often a word or phrase occurs, as a shard sends it once.
    """
    spark = docs.sparkSession
    on_workers(spark)
    folder = shared_dir(spark)
    placed = located(docs, f"{folder}/rows")
    text, lang = F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.coalesce(F.col("row.lang").cast("string"), F.lit("und"))
    size = placed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    pieces = placed.select("place", lang.alias("lang"), F.posexplode(F.when(F.octet_length(text) <= long_text, F.array(text)).otherwise(F.split(text, _ENDS))).alias("piece", "text"))
    # neighbours of a text that is cut go to one shard; the place spreads rows that repeat
    block = F.pmod(F.xxhash64("place.file", "place.row", F.shiftright("piece", 12)), F.lit(n)).alias("block")
    dealt = pieces.select(block, "lang", F.col("text").cast("binary").alias("text"))
    with cleaned_shuffles(spark):
        index = written(dealt.groupBy("block").applyInArrow(_indexed, _INDEX_SQL), f"{folder}/index", WIDE_ROWS)
        sums = index.select(F.explode("langs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
        words = delivered(index.select("block", "names", "counts").mapInArrow(_sent_words(n, fan), LETTERS), n, f"{folder}/words", fan, WIDE_ROWS)
        answers = delivered(words.groupBy("node").applyInArrow(_answered_words(least, n, fan), LETTERS), n, f"{folder}/known-1", fan, WIDE_ROWS).withColumn("level", F.lit(1))
        forgotten(spark, f"{folder}/words")
        for length in range(2, longest + 1):
            both = index.select("block", "words", "names").groupBy("block").cogroup(answers.groupBy("node"))
            found = delivered(both.applyInArrow(_sent_phrases(length, n, fan), LETTERS), n, f"{folder}/phrases-{length}", fan, WIDE_ROWS)
            known = found.groupBy("node").applyInArrow(_answered_phrases(length, least, length == longest, fan), LETTERS)
            answers = answers.unionByName(delivered(known, n, f"{folder}/known-{length}", fan, WIDE_ROWS).withColumn("level", F.lit(length)))
            forgotten(spark, f"{folder}/phrases-{length}")
        both = index.select("block", "names").groupBy("block").cogroup(answers.groupBy("node"))
        return written(both.applyInArrow(_told(longest, n), _CANDIDATES_SQL), f"{folder}/candidates"), written(sums, f"{folder}/langs")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, first: int = 2_000, parts: int = 64, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then by frequency, then by their bytes.

    Reads text and lang, ignores other columns. A null text is empty, a null lang is `und`. Everything counts by language; rows that repeat count each,
    ties in all don't occur, as a language has a phrase once. No row, no word or no frequent phrase gives no result. Texts of any length
    are read, cut at their pieces; a piece without an end is read as a whole.

    A phrase goes if a longer one with all its words in a row occurs at least `within` percent as often. Of each language the
    first rows of each of some parts are taken before these meet, so the last step sorts a bounded number a language.
    """
    found, langs = candidates(docs, longest, least, **how)
    size = F.size("ids")
    inside = found.where(size > 2).select("a", "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    inside = inside.select("a", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - F.col("k") + 1), lambda i: F.slice("ids", i, F.col("k")))).alias("ids"))
    most = inside.groupBy("ids").agg(F.max("a").alias("most"))
    left = found.join(most, "ids", "left").where(F.col("most").isNull() | (100 * F.col("most") < within * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    top = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= first)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return top.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

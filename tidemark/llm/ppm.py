"""Operator 10: language-model scores by prediction by partial matching over bytes, and by a unigram of words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import FAN, bundled, delivered, forgotten, received, sent, table, unbundled
from tidemark.llm.exchange import SCHEMA as LETTERS
from tidemark.llm.shared import cleaned_shuffles, kept_by_worker, located, on_workers, remainder, segments, shared_dir, words, written

#: Bytes of context. A node of the trie is a context; its children are the bytes seen after it.
ORDER = 4
#: Neither occurs in UTF-8: what stands before a text, and what ends it.
BEFORE, END = 0xFF, 0xFE
#: The bytes that a text can have, and END.
SYMBOLS = 255
#: The token at the end of a text, which no word equals.
END_TOKEN = ""
#: Bytes of text in a block; a block's documents are scored by one task.
BLOCK = 16_000_000


def grams(text: bytes) -> np.ndarray:
    """For each byte of the text and its end, the ORDER bytes before it and itself as one number."""
    b = np.frombuffer(bytes([BEFORE] * ORDER) + text + bytes([END]), np.uint8).astype(np.int64)
    g = np.zeros(len(b) - ORDER, np.int64)
    for i in range(ORDER + 1):
        g = g << 8 | b[i : len(g) + i]
    return g


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, and the sums of n."""
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, n)
    return distinct, at, total


def log_probabilities(gram: np.ndarray, n: np.ndarray, two: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each gram's probability: of its last byte after the bytes before it.

    gram: distinct, with all grams that share the last three bytes of context, and n, how often each was seen, 0 for
    those to predict only. two: four columns that say of the last two bytes of context how often the gram's byte
    followed, how often any, how many did, and how often those did after the last byte alone. pairs: 256 by 256, how
    often a byte (column) followed a byte (row) anywhere.

    From the longest context down: a byte seen in a context has n / (total + distinct), else the context is
    escaped with distinct / (total + distinct). Bytes of the contexts escaped are excluded from the counts of
    the shorter ones: as all of them occur there too, their part of total and distinct is subtracted. A context
    never seen, or with no byte left, is passed at no cost. At last all bytes never seen share alike.
    """
    symbol, row = gram & 255, (gram >> 8) & 255
    single, follows = pairs.sum(0), pairs > 0
    counts, totals, seens, places = [], [], [], []  # per gram, from the longest context to the empty one
    for order in range(ORDER, 2, -1):
        key = gram & ((1 << 8 * (order + 1)) - 1)
        _, at, count = _summed(key, n)
        context, of, total = _summed(key >> 8, n)
        first = np.unique(at, return_index=True)[1]  # one gram for each key
        seen = np.zeros(len(context), np.int64)
        np.add.at(seen, of[first], count > 0)
        counts.append(count[at])
        totals.append(total[of])
        seens.append(seen[of])
        places.append((first, of, len(context)))
    counts += [two[:, 0], pairs[row, symbol], single[symbol]]
    totals += [two[:, 1], pairs.sum(1)[row], np.full(len(gram), single.sum())]
    seens += [two[:, 2], follows.sum(1)[row], np.full(len(gram), (single > 0).sum())]
    # what the bytes seen in a context count in the next shorter one
    parts = []
    for (first, of, contexts), count, below in zip(places, counts, counts[1:], strict=False):
        part = np.zeros(contexts, np.int64)
        np.add.at(part, of[first], np.where(count[first] > 0, below[first], 0))
        parts.append(part[of])
    parts += [two[:, 3], (follows * single).sum(1)[row]]

    out = np.zeros(len(gram))
    open_ = np.ones(len(gram), bool)
    less_total, less_seen = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for k, (count, total, seen) in enumerate(zip(counts, totals, seens, strict=True)):
        t, d = total - less_total, seen - less_seen
        hit = open_ & (count > 0)
        out[hit] += np.log10(count[hit] / (t + d)[hit])
        miss = open_ & (count == 0) & (d > 0)
        out[miss] += np.log10(d[miss] / (t + d)[miss])
        open_ &= ~hit
        if k < len(parts):
            less_total, less_seen = parts[k], seen
    out[open_] -= np.log10((SYMBOLS - seens[-1])[open_])
    return out


def weighed(seen: DataFrame, n_parts: int) -> DataFrame:
    """bucket, gram and value, the log10 probability, of all grams: seen has bucket, gram and n.

    What the two last bytes of context say is grouped and joined by key, at most 2**16 rows a key; the grams of three
    bytes of context meet in one of n_parts parts, so a part is large only where all of a corpus's grams are.
    """
    last = F.col("gram").bitwiseAND(F.lit(0xFFFF))
    pair = seen.groupBy(last.alias("pair")).agg(F.sum("n").alias("n_pair"))  # at most 2**16 rows
    pairs = np.zeros((256, 256), np.int64)
    for r in pair.collect():
        pairs[r.pair >> 8, r.pair & 255] = r.n_pair
    three = seen.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("three")).agg(F.sum("n").alias("count")).withColumn("pair", F.col("three").bitwiseAND(F.lit(0xFFFF)))
    after = F.col("count") > 0
    of_two = three.join(F.broadcast(pair), "pair").groupBy(F.shiftright("three", 8).alias("two")).agg(F.sum("count").alias("total"), F.count_if(after).alias("distinct"), F.coalesce(F.sum(F.when(after, F.col("n_pair"))), F.lit(0)).alias("below"))
    three = three.withColumn("two", F.shiftright("three", 8)).join(F.broadcast(of_two), "two").select("three", "count", "total", "distinct", "below")  # at most 2**16 rows
    rows = seen.withColumn("three", F.col("gram").bitwiseAND(F.lit(0xFFFFFF))).join(three, "three").drop("three")

    def run(t: pa.Table) -> pa.Table:
        gram, n = (t.column(c).to_numpy() for c in ("gram", "n"))
        two = np.stack([t.column(c).to_numpy() for c in ("count", "total", "distinct", "below")], axis=1)
        return pa.table({"bucket": t.column("bucket"), "gram": t.column("gram"), "value": log_probabilities(gram, n, two, pairs)})

    part = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(n_parts))
    return rows.groupBy(part.alias("part")).applyInArrow(run, "bucket long, gram long, value double")


def _counted(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(arrays), return_counts=True) if arrays else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    distinct, _, total = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return distinct, total


def _features(texts: pa.Table, part: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """A block's distinct grams with their counts in texts to learn from, and its distinct words with theirs."""
    parts, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], {True: [], False: []}
    tokens = {True: Counter(), False: Counter()}
    size = 0

    def flush() -> None:
        for train, arrays in held.items():
            keys, n = _counted(arrays)
            parts.append((keys, n if train else np.zeros_like(n)))
            arrays.clear()
        parts[:] = [_merged(parts)]

    for train, text in zip(texts.column("train").to_pylist(), texts.column("text").to_pylist(), strict=True):
        raw = text.encode().lower()
        held[train].append(grams(raw))
        size += len(raw)
        if size > part:
            flush()
            size = 0
        for piece in segments(raw.decode()):
            tokens[train].update(words(piece))
        tokens[train][END_TOKEN] += 1
    flush()
    return *parts[0], dict.fromkeys(tokens[False], 0) | tokens[True]


def _send(texts: pa.Table, buckets: int, fan: int) -> Iterator[dict]:
    """For each bucket, the block's grams and words in it."""
    kept_by_worker(None, bool)
    keys, n, tokens = _features(texts)
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    found, begin = np.unique(of[order], return_index=True)
    parts = {b: order[at:to] for b, at, to in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)}
    lists: dict[int, list[str]] = {}
    for w in tokens:
        lists.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
    block = texts.column("block")[0].as_py()

    def message(bucket: int) -> bytes:
        own, some = parts.get(bucket, order[:0]), lists.get(bucket, [])
        return bundled(keys[own].tobytes(), n[own].astype("<u4").tobytes(), "\n".join(some).encode(), np.array([tokens[w] for w in some], "<u4").tobytes())

    return sent(block, ((block, b, message(b)) for b in sorted(parts.keys() | lists.keys())), fan)


def _taken(rows: pa.Table) -> list[tuple]:
    """block, grams, their counts, words and their counts of the messages to a bucket."""
    out = []
    for block, _, m in received(rows):
        grams_, n, some, n_words = unbundled(m, 4)
        n_words = np.frombuffer(n_words, "<u4")
        out.append((block, np.frombuffer(grams_, "<i8"), np.frombuffer(n, "<u4").astype(np.int64), bytes(some).decode().split("\n") if len(n_words) else [], n_words))
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _words_of(taken: list[tuple]) -> Counter:
    total: Counter = Counter()
    for *_, some, n_words in taken:
        for w, n in zip(some, n_words.tolist(), strict=True):
            if n:
                total[w] += n
    return total


def _reduce(rows: pa.Table) -> pa.Table:
    """A bucket's distinct grams with their counts in all blocks, and a row for its words."""
    taken, bucket = _taken(rows), rows.column("node")[0].as_py()
    grams_, n = _merged([(g, n) for _, g, n, *_ in taken])
    total = _words_of(taken)
    none = [None] * len(grams_)
    cols = ([bucket] * (len(grams_) + 1), [*grams_.tolist(), None], [*n.tolist(), None], [*none, sum(total.values())], [*none, len(total)])
    return pa.table([pa.array(c, pa.int64()) for c in cols], schema=_arrow(_REDUCED))


def _answer(rows: pa.Table, weights: pa.Table, fan: int) -> Iterator[dict]:
    """To each block: the probabilities of the grams and the counts of the words that it sent to a bucket."""
    taken, bucket = _taken(rows), rows.column("node")[0].as_py()
    keys, values = weights.column("gram").to_numpy(), weights.column("value").to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    total = _words_of(taken)

    def message(grams_: np.ndarray, some: list[str]) -> bytes:
        found = values[np.searchsorted(keys, grams_)] if len(grams_) else values[:0]
        return bundled(grams_.tobytes(), found.tobytes(), "\n".join(some).encode(), np.array([total[w] for w in some], "<i8").tobytes())

    return sent(bucket, ((bucket, block, message(g, some)) for block, g, _, some, _ in taken), fan)


class Table:
    """Values by gram, for grams that are all there: a hash gives a slot, and slots of several grams are searched."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        slots = self.slot(self.keys)
        taken = np.bincount(slots, minlength=1 << self.BITS)
        self.direct = np.full(1 << self.BITS, np.nan)
        alone = taken[slots] == 1
        self.direct[slots[alone]] = self.values[alone]

    def slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)

    def sum(self, g: np.ndarray) -> float:
        v = self.direct[self.slot(g)]
        other = np.flatnonzero(np.isnan(v))
        v[other] = self.values[np.searchsorted(self.keys, g[other])]
        return float(v.sum())


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, block_bytes: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from all rows whose crc32(doc_id as text) isn't 1 modulo 5; a null id counts as the empty
    text, a null text is empty. A-Z is lower-cased first. score is the log10 probability of the text's bytes
    and its end under PPM (escapes by method C, exclusion, order 4), base_score that of its words and its end
    under a smoothed unigram. With nothing to learn from, all bytes are equally likely. Repeated rows are
    scored each, extra columns are ignored, no row gives no result.

    Documents are dealt to blocks and keys to as many buckets. A block sends each distinct word and gram once,
    whatever their number of occurrences; a bucket sums over all blocks, and sends back to each the counts of
    its words and the probabilities of its grams. In between, the distinct grams of the whole corpus are weighed.
    """
    spark = docs.sparkSession
    on_workers(spark)
    folder = shared_dir(spark)
    placed = located(docs, f"{folder}/rows")
    doc_id, text = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    size = placed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    # the place spreads rows that repeat id and text, and is the same whenever the table is read
    block = F.pmod(F.xxhash64(doc_id, text, "place.file", "place.row"), F.lit(n)).alias("block")
    dealt = placed.select(doc_id.alias("doc_id"), (remainder(doc_id, 5) != 1).alias("train"), text.alias("text"), block)
    result = _arrow(SCHEMA)

    with cleaned_shuffles(spark):
        features = delivered(dealt.groupBy("block").applyInArrow(lambda t: table(_send(t, n, fan)), LETTERS), n, f"{folder}/features", fan)
        reduced = written(features.groupBy("node").applyInArrow(_reduce, _REDUCED), f"{folder}/reduced")
        tokens, distinct = reduced.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
        trie = weighed(reduced.where("gram IS NOT NULL").select("bucket", "gram", "n"), n)
        answers = features.groupBy("node").cogroup(trie.groupBy("bucket")).applyInArrow(lambda t, w: table(_answer(t, w, fan)), LETTERS)
        answers = delivered(answers, n, f"{folder}/answers", fan)
        forgotten(spark, f"{folder}/features")
        out = written(dealt.groupBy("block").cogroup(answers.groupBy("node")).applyInArrow(lambda t, a: table(_score(t, a, tokens, distinct), result), SCHEMA), f"{folder}/result")
        forgotten(spark, f"{folder}/answers")
        return out


_REDUCED = "bucket long, gram long, n long, tokens long, distinct long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def _score(texts: pa.Table, answers: pa.Table, tokens: int, distinct: int) -> Iterator[dict]:
    got = [unbundled(m, 4) for *_, m in received(answers)]
    probable = Table(np.concatenate([np.frombuffer(g, "<i8") for g, *_ in got]), np.concatenate([np.frombuffer(v, "<f8") for _, v, *_ in got]))
    floor = tokens + 0.5 * (distinct + 1)
    unknown = float(np.log10(0.5 / floor))
    known: dict[str, float] = {}
    for *_, some, c in got:
        if len(c):
            c = np.frombuffer(c, "<i8")
            known.update(zip(bytes(some).decode().split("\n"), np.where(c > 0, np.log10((c + 0.5) / floor), unknown).tolist(), strict=True))
    for doc_id, train, text in zip(texts.column("doc_id").to_pylist(), texts.column("train").to_pylist(), texts.column("text").to_pylist(), strict=True):
        raw = text.encode().lower()
        values = [known[END_TOKEN]]
        n, missed, base = 1, values.count(unknown), values[0]
        for piece in segments(raw.decode()):
            values = [known[w] for w in words(piece)]
            n, missed, base = n + len(values), missed + values.count(unknown), base + sum(values)
        yield {"doc_id": doc_id, "held_out": not train, "n_tokens": n, "n_known": n - missed, "train_tokens": tokens, "base_score": base, "score": probable.sum(grams(raw))}

"""Operator 5: language identification by sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_by_worker, on_workers, remainder, segments

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


@dataclass(frozen=True)
class Settings:
    """sample bounds the labelled documents of each language that the weights are learnt from, total those of all
    languages together, but for `least` of each. Document frequencies are of all documents to learn from.

    All languages are learnt. cells bounds the model: with so many languages that buckets times languages would be
    more, there are fewer buckets, 256 at least.
    """

    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    sample: int = 1500
    total: int = 6000
    least: int = 8
    cells: int = 1 << 23
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    calibration: float = 0.2

    def of(self, languages: int) -> Settings:
        """The settings for a number of languages."""
        fit = 1 << max(8, (self.cells // max(languages, 1)).bit_length() - 1)
        return replace(self, buckets=min(self.buckets, fit), sample=min(self.sample, max(self.least, self.total // max(languages, 1))))


def grams(text: str, settings: Settings) -> np.ndarray:
    """The buckets of a text's character n-grams, in lower case, with runs of other characters than letters as one blank."""
    out = []
    for part in segments(text):
        code = np.frombuffer((" " + _NO_LETTERS.sub(" ", part.lower()).strip(" ") + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = np.zeros(len(code), np.uint64)
        for n in range(1, max(settings.orders) + 1):
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
            if n in settings.orders:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed >> np.uint64(40)).astype(np.int64) % settings.buckets)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counted(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts."""
    c = np.bincount(grams(text, settings), minlength=settings.buckets)
    at = np.flatnonzero(c)
    return at, c[at]


def weighted(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = count * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


class FollowTheRegularisedLeader:
    """Multinomial logistic regression, one example after the other, with per-coordinate steps.

    Weights are lazy functions of the accumulated gradients z and their squares n: those whose z stays
    under l1 are exactly zero, and l2 shrinks the others.
    """

    def __init__(self, features: int, classes: int, settings: Settings):
        self.z, self.n, self.s = np.zeros((features, classes)), np.zeros((features, classes)), settings

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its calibrated probability; for a text without a letter, or without a language to choose from, und and 0."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        at, count = counted(text, self.settings)
        p = softmax(weighted(at, count, self.idf) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in two bytes each, or four if they are larger, with the width in front."""
    wide = len(numbers) and numbers.max() > 0xFFFF
    return b"42"[1 - wide : 2 - wide] + numbers.astype("<u4" if wide else "<u2").tobytes()


def _back(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=1)


def _frequencies(labelled: DataFrame, settings: Settings) -> np.ndarray:
    """Documents by bucket, of all documents: each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(None, bool)
        total, there = np.zeros(settings.buckets, np.int64), np.zeros(settings.buckets, bool)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at = grams(text, settings)
                there[at] = True
                total += there
                there[at] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(settings.buckets)
    for r in labelled.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def drawn(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) for each labelled document: those with the smallest are learnt from."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(5)), 11) / F.lit(float(2**53))


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """labelled: doc_id, text, lang, without nulls but in doc_id.

    The driver gets at most settings.total documents, settings.sample of a language, as sparse counts of at most
    four bytes a bucket: those with the smallest hashes of doc_id and text. Some of them are kept apart to fit the temperature.
    """
    spark = labelled.sparkSession
    on_workers(spark)
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # the classes
    languages = sorted(r.lang for r in sizes)
    settings = settings.of(len(languages))
    documents = _frequencies(labelled, settings)
    idf = np.log((1 + sum(r.n for r in sizes)) / (1 + documents)) + 1
    if not languages:
        return Model([], idf, np.zeros((settings.buckets, 0)), 1.0, settings)
    shares = spark.createDataFrame([(r.lang, min(1.0, settings.sample * 0.9 / r.n)) for r in sizes], "lang string, share double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counted(t, settings) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("lang"), pa.array([_small(a) for a, _ in got], pa.binary()), pa.array([_small(c) for _, c in got], pa.binary())], ["h", "lang", "at", "count"]
            )

    hashed = labelled.withColumn("h", drawn(F.col("doc_id"), F.col("text"))).join(F.broadcast(shares), "lang")  # a row a class
    chosen = hashed.where("h < share").select("h", "lang", "text").orderBy("h").limit(settings.sample * len(languages))
    rows = sorted(chosen.mapInArrow(run, "h double, lang string, at binary, count binary").collect(), key=lambda r: (r.h, r.lang, r.at))
    # hashes order the documents at random: the first part is learnt from, the rest calibrates
    index = {x: i for i, x in enumerate(languages)}
    data = []
    for r in rows:
        at = _back(r["at"]).astype(np.int32)
        data.append((at, weighted(at, _back(r["count"]).astype(float), idf).astype(np.float32), index[r.lang]))
    order = np.random.default_rng(5).permutation(len(data))
    held = set(order[: int(len(data) * settings.calibration)].tolist())
    leader = FollowTheRegularisedLeader(settings.buckets, len(languages), settings)
    for _ in range(settings.epochs):
        for i in order:
            if i not in held:
                leader.learn(*data[i])
    weights = leader.weights(slice(None))
    apart = [data[i] for i in order if i in held]
    logits = np.array([x @ weights[at] for at, x, _ in apart]).reshape(len(apart), len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for *_, y in apart], int)), settings)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Learns from text and lang of the rows whose crc32(doc_id as text) isn't 1 modulo 3 (a null id counts as
    the empty text) and that have a lang and a letter; lang, source and doc_id are no inputs of a prediction.
    A null text or one without a letter is und with score 0, and so is each text if there is nothing to learn
    from. Repeated rows are predicted each; extra columns are ignored; no row gives no result.
    The model has settings.cells weights at most, whatever the number of languages, and goes to the tasks as it is.
    """
    on_workers(docs.sparkSession)
    held_out = remainder(F.col("doc_id"), 3) == 1
    text = F.col("text").cast("string")
    model = train(docs.where(~held_out & F.col("lang").isNotNull() & text.rlike(r"\p{L}")).select(F.col("doc_id").cast("long"), text.alias("text"), F.col("lang").cast("string")), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text.alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

import hashlib
import math
import re
import zlib

import pytest

from tidemark.llm.queries import op12_crc_ring_resampling
from tidemark.llm.resampling import drawn, resampled, word_runs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    """doc_id, n_features, weight, score and rank of each document, by the definition."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in docs:
        words, of = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of)
        out.append([doc_id, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = found(op12_crc_ring_resampling(spark, sf))
    assert got == plain(docs, target) and any(r[4] for r in got)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_the_ring_goes_on_from_part_to_part(size):
    for text in ["", "a", " a  b ", "One two, three-four FIVE six. é ü 7 8 9 " * 20, "x" * 50, "\U0001f600 a\tb\nc"]:
        states = [s for lists in word_runs(text.encode(), size=size) for each in lists for s in each]
        assert sorted(s % 10_000 for s in states) == sorted(features(text)[1])


def test_odd_rows(spark, odd, nothing):
    docs, target = [tuple(r) for r in odd.select("doc_id", "text").collect()], ["the cat sat on the mat", None]
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    assert found(resampled(odd, benchmark)) == plain(docs, target)
    assert found(resampled(odd, benchmark.where("false"))) == plain(docs, [])
    assert found(resampled(nothing, benchmark)) == []
    many = odd.selectExpr("*", "explode(sequence(1, 30)) AS n").drop("n")  # rows that repeat, and tie
    assert found(resampled(many, benchmark)) == plain(docs * 30, target)
    got = drawn(many, benchmark)
    assert got.columns == odd.columns and got.count() == sum(r[4] is not None for r in plain(docs * 30, target))


def test_a_very_long_text(spark):
    docs = [(1, "Alpha beta, gamma " * 200_000), (2, "word " * 30), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(resampled(df, df.where("doc_id = 2"))) == plain(docs, [docs[1][1]])

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repeats
from tidemark.llm.repeats import cut, earlier, first_seen, intervals, period, runs, without_repeats

N = repeats.LENGTH


def brute(rows):
    """[(doc_id, text)] to sorted results."""
    key = lambda d: 2**63 - 1 if d is None else d
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - N + 1):
            w = b[i : i + N]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - N + 1):
            if first[b[i : i + N]] < key(d):
                gone[i : i + N] = [True] * N
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key(d), len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@given(st.binary(max_size=200), st.integers(1, 60))
def test_runs_cover_all_passages(raw, part):
    b = np.frombuffer(raw, np.uint8)
    key, start, size = runs(b, part)
    assert size.sum() == max(0, len(b) - N + 1) and (len(key) < 2 or (key[1:] != key[:-1]).all())
    for k, s, n in zip(key, start, size):
        assert all(runs(b[i : i + N])[0][0] == k for i in range(s, s + n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=40), min_size=1, max_size=12), st.integers(1, 12))
def test_intervals(parts, length):
    text = np.frombuffer(b"".join(p.encode() + b"\xff" for p in parts), np.uint8)
    order, mark = intervals(text, length)
    raw = text.tobytes()
    keys = [raw[i : i + length] for i in order.tolist()]
    inner = [b"\xff" not in k and len(k) == length for k in keys]
    for j in range(1, len(keys)):
        if inner[j] and inner[j - 1]:
            assert mark[j] == (keys[j] != keys[j - 1])
        elif inner[j] != inner[j - 1]:
            assert mark[j]
    assert sorted(order.tolist()) == list(range(len(raw)))


def texts(n, seed=0):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(40, 200))) for _ in range(6)]
    out = []
    for i in range(n):
        t = "".join(rng.choices("abcdé ", k=rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            at, j = rng.randint(0, len(t)), rng.randint(0, 30)
            t = t[:at] + s[j : len(s) - rng.randint(0, 30)] + t[at:]
        out.append((rng.randint(0, 2 * n), t))
    return out + [(1, "z" * 500), (n, "z" * 120), (3, None), (None, shared[0]), (None, "z" * 60), (2, ""), (n + 1, "ab" * 300), (n + 2, "ba" * 100)]


def test_first_seen():
    strings = [t.encode() for _, t in texts(40) if t and len(t.encode()) >= N]
    docs = np.arange(len(strings))[::-1].copy()
    want = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - N + 1):
            want[s[i : i + N]] = min(want.get(s[i : i + N], 10**9), d)
    assert first_seen(strings, docs).tolist() == [want[s[i : i + N]] for s in strings for i in range(len(s) - N + 1)]
    distinct = list(dict.fromkeys(strings))
    for index in (300, 10**6):
        got = earlier(distinct, np.arange(len(distinct)), np.zeros(len(distinct), np.uint64), index=10**9)
        assert got.any() and not got.all()


def test_cut():
    left, n, spans = cut(bytes(range(120)), np.array([i in (0, 1, 60) for i in range(71)]))
    assert (left, n, spans) == (bytes([*range(51, 60), *range(110, 120)]), 101, 2)


@pytest.mark.parametrize(("block", "hot", "fan"), [(16_000_000, 10_000, 128), (3_000, 10_000, 2), (3_000, 3, 128)])
def test_against_all_passages(spark, block, hot, fan):
    rows = texts(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(without_repeats(df, block_bytes=block, hot=hot, index=2_000, fan=fan)) == brute(rows)


def test_rows_that_repeat_id_and_text_are_dealt_to_many_blocks(spark):
    df = spark.range(300).selectExpr("CAST(IF(id < 200, NULL, 7) AS LONG) AS doc_id", "repeat('the same text over and over, ', 4) AS text")
    assert found(without_repeats(df, block_bytes=3_000)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(without_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    few = odd.where("doc_id IS NULL OR doc_id <> 6")
    assert found(without_repeats(few)) == brute([(r.doc_id, r.text) for r in few.collect()])
    assert without_repeats(odd).count() == 11 and without_repeats(nothing).count() == 0
    kept = {r.doc_id: r.kept for r in without_repeats(docs, with_text=True).collect()}
    assert {hashlib.sha256(k).hexdigest() for k in kept.values()} == {r.kept_sha256 for r in without_repeats(docs).collect()}


def test_strings_that_repeat_themselves_are_indexed_once():
    assert [period(x) for x in (b"=" * 300, b"- " * 200, b"abc" * 100, b"x" + b"=" * 300, b"=" * 300 + b"x", b"=" * 60)] == [1, 2, 3, 0, 0, 0]
    strings = [b"=" * (250 + i) for i in range(40)] + [b"ab" * 150, b"ba" * 140, b"q" + b"=" * 300, bytes(range(60, 120)) * 6, bytes(range(60, 120)) * 2]
    docs = np.array([(7 * i) % 45 for i in range(len(strings))])
    keys = np.zeros(len(strings), np.uint64)
    least = {}
    for s, d in zip(strings, docs.tolist(), strict=True):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(d, least.get(s[i : i + 50], d))
    want = [least[s[i : i + 50]] < d for s, d in zip(strings, docs.tolist(), strict=True) for i in range(len(s) - 49)]
    assert earlier(strings, docs, keys).tolist() == want


def test_a_hot_key_of_padding_is_small():
    strings, docs = [b"=" * (20_000 + i) for i in range(2_000)], np.arange(2_000)  # 40 MB under one key
    tracemalloc.start()
    found = earlier(strings, docs, np.zeros(2_000, np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found[: 20_000 - 49].any() and found[20_000 - 49 :].all() and peak < 3 * len(found)


def test_blocks_with_nothing_to_send(spark):
    """Texts under 50 bytes only, and blocks that share nothing with any other."""
    short = spark.createDataFrame([(i, "a short text" * (i % 3)) for i in range(40)], "doc_id long, text string")
    apart = spark.createDataFrame([(i, hashlib.sha512(str(i).encode()).hexdigest() * (i % 2)) for i in range(40)], "doc_id long, text string")
    for docs in (short, apart):
        for block in (200, 1 << 23):
            got = without_repeats(docs, block_bytes=block).collect()
            assert len(got) == 40 and {(r.n_removed, r.n_spans) for r in got} == {(0, 0)}
            assert {r.doc_id: r.kept_sha256 for r in got} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}

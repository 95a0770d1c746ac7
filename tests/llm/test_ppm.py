import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.ppm import ORDER, Table, grams, log_probabilities, scores
from tidemark.llm.shared import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def symbols(text):
    return [0xFF] * ORDER + list(text.encode()) + [0xFE]


def learnt(texts):
    """{context: counts of the next byte} for contexts of 0 to ORDER bytes."""
    trie = defaultdict(Counter)
    for t in texts:
        b = symbols(t)
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                trie[tuple(b[i - k : i])][b[i]] += 1
    return trie


def brute(trie, text):
    b, out = symbols(text), 0.0
    for i in range(ORDER, len(b)):
        gone = set()
        for k in range(ORDER, -1, -1):
            node = {s: n for s, n in trie.get(tuple(b[i - k : i]), {}).items() if s not in gone}
            if not node:
                continue
            total, distinct = sum(node.values()), len(node)
            if b[i] in node:
                out += math.log10(node[b[i]] / (total + distinct))
                break
            out += math.log10(distinct / (total + distinct))
            gone |= set(node)
        else:
            out -= math.log10(255 - len(gone))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é", max_size=14), max_size=6), st.text(alphabet="abcdé 漢", max_size=14))
def test_probabilities(texts, query):
    trie = learnt(texts)
    count = Counter(int(g) for t in texts for g in grams(t.encode()))
    for g in grams(query.encode()):
        count.setdefault(int(g), 0)
    pairs = np.zeros((256, 256), int)
    for g, n in count.items():
        pairs[g >> 8 & 255, g & 255] += n
    two = defaultdict(Counter)
    for g, n in count.items():
        two[g >> 8 & 0xFFFF][g & 255] += n
    after = lambda g: (two[g >> 8 & 0xFFFF], g >> 8 & 255)
    of_two = lambda g: (after(g)[0][g & 255], sum(after(g)[0].values()), sum(n > 0 for n in after(g)[0].values()), sum(pairs[after(g)[1], s] for s, n in after(g)[0].items() if n))
    value = {}
    for end in {(g >> 8 & 0xFFFFFF) % 3 for g in count}:
        own = np.array([g for g in count if (g >> 8 & 0xFFFFFF) % 3 == end])
        value |= zip(own.tolist(), log_probabilities(own, np.array([count[int(g)] for g in own]), np.array([of_two(int(g)) for g in own]), pairs).tolist())
    assert math.isclose(sum(value[int(g)] for g in grams(query.encode())), brute(trie, query), abs_tol=1e-9)


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**40, 400_000))
    values = rng.normal(size=len(keys))
    some = rng.integers(0, len(keys), 10_000)
    assert math.isclose(Table(keys, values).sum(keys[some]), values[some].sum(), abs_tol=1e-6)


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    for df in (docs, odd):
        rows = [(r.doc_id, (r.text or "").translate(LOWER)) for r in df.collect()]
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        train = [t for d, t in rows if not held(d)]
        count = Counter(w for t in train for w in [*words(t), None])
        n, v = sum(count.values()), len(count)
        trie = learnt(train)
        want = sorted(
            (-1 if d is None else d, held(d), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 5), round(brute(trie, t), 5))
            for d, t in rows
        )
        for block, fan in ((10_000, 3), (40_000, 128), (16_000_000, 128)):
            got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5], round(r.base_score, 5), round(r.score, 5)) for r in scores(df, block, fan).collect())
            assert [g[:5] for g in got] == [w[:5] for w in want]
            assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=2e-4)
    assert scores(nothing).count() == 0


def test_held_out_texts_of_the_language_score_better(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = {r.doc_id: len(r.text.encode()) + 1 for r in docs.collect()}
    bits = [-r.score / n[r.doc_id] / math.log10(2) for r in scores(docs).where("held_out").collect()]
    assert np.median(bits) < 3.5

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.topk import pruned_search, top_k

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, query, k=10):
    """(query_id, rank, vec_id, score) by scoring every pair."""
    kept = []
    for vec_id, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in e]))
    out = []
    for i, (q, a) in enumerate(kept):
        if q is None or not query(q):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0, c) for j, (c, b) in enumerate(kept) if j != i]
        out += [(q, n, c, -s) for n, (s, _, _, c) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def found(spark, rows, query, **how):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], ROWS).selectExpr("*", "1 AS row", "2 AS rank", "3 AS score", "4 AS chunk")
    return Counter(tuple(r) for r in top_k(df, query(F.col("vec_id")), **how).collect())


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * (rng.random(d) < 0.4) / 4).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "shard", "chunk"), [(700, 16_384, 2_048), (700, 150, 40)])
def test_against_all_pairs(spark, n, shard, chunk):
    rows = vectors(n, 16, 1)
    rows += [(1_000 + i, rows[7][1]) for i in range(300)]  # one very common vector: many ties
    assert found(spark, rows, lambda c: c % 20 == 0, shard=shard, chunk=chunk) == plain(rows, lambda c: c % 20 == 0)


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (100, [0.1]), (None, [0.5, 0.5]), (None, [0.5, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (200, []), (6, [-1.0, -1.0, 2.0]), (7, [1.0, 3.0])]
    assert found(spark, rows, lambda c: c % 100 == 0) == plain(rows, lambda c: c % 100 == 0)
    assert found(spark, rows[:1], lambda c: c % 100 == 0) == Counter()
    assert found(spark, rows[5:8], lambda c: c % 100 == 0) == Counter()
    assert found(spark, [], lambda c: c % 100 == 0) == Counter()


def test_large_components_are_exact_and_saturate(spark):
    rows = [(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6 + 1, -1.0]), (3, [-2e30, 1.0]), (4, [3e30, 1.0])]
    got = found(spark, rows, lambda c: c == 0)
    assert got == Counter((q, n, c, max(min(s, 2**63 - 1), -(2**63) + 1)) for q, n, c, s in plain(rows, lambda c: c == 0))


def test_blocks_below_the_kth_score_are_not_read():
    rng = np.random.default_rng(3)
    blocks = []
    for b in range(20):  # each block has terms of its own
        m = np.zeros((64, 40))
        m[:, 2 * b : 2 * b + 2] = rng.integers(1, 100, (64, 2))
        blocks.append({"id": np.arange(64) + 64 * b, "row": np.arange(64) + 64 * b, "vectors": m, "maxima": m.max(0, keepdims=True), "minima": m.min(0, keepdims=True)})
    queries = np.stack([blocks[b]["vectors"][0] for b in range(20)])
    best, scored = pruned_search(queries, np.array([64 * b for b in range(20)]), np.full(20, -(2**63)), blocks, 10)
    assert scored == 20  # of 400 pairs
    for b in range(20):
        s = blocks[b]["vectors"] @ queries[b]
        assert best.score[b].tolist() == sorted(s[1:].astype(int).tolist(), reverse=True)[:10]

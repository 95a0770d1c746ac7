import random

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import shared_dir, written
from tidemark.llm.simhash import fingerprint, links, near_groups, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(ids):
    """ids: {node: rank} of unsigned fingerprints."""
    fps = np.array(sorted(ids), np.uint64)
    label = np.array([ids[int(f)] for f in fps])
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 2) for f in fps]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(map(int, fps), label.tolist()))
        label = new


def test_fingerprints():
    for t in (None, "", " \n", "one", "One two", "one two THREE", "É é\x1cx a b c d e f g", "a a a a a a b"):
        assert fingerprint(t) % 2**64 == brute_fingerprint(t)


def test_a_long_text_in_parts(monkeypatch):
    from tidemark.llm import shared, simhash

    text = " ".join(random.Random(1).choices("abc def gh ij k".split(), k=3000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "segments", lambda t: shared.segments(t, 97))
    assert fingerprint(text) == whole


def planted(n=150, each=12):
    rng = random.Random(3)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, each)):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
    x = rng.getrandbits(64)
    out |= {x ^ (1 << b) ^ (1 << c) for b in range(0, 32, 2) for c in range(1, 32, 3)}  # a full bucket in the second table
    return out


def test_links_have_the_components_of_all_pairs(spark):
    fps = sorted(planted())
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    want = brute_components({f: i for i, f in enumerate(fps)})
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "node long, rank long")
    for bucket in (2, 16, 10_000):
        folder = shared_dir(spark)
        pairs = links(df.select(F.col("node").alias("fp")), folder, bucket)
        got = {r.node % 2**64: r.component for r in components(pairs, df, folder).collect()}
        assert {f: got.get(f, i) for i, f in enumerate(fps)} == want


def test_a_long_chain_takes_few_rounds(spark):
    n = 400
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 5, n + 6)], "a long, b long")
    nodes = spark.createDataFrame([(i, i) for i in range(n + 7)], "node long, rank long")
    got = {r.node: r.component for r in components(edges, nodes, shared_dir(spark)).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[n + 6] == n + 5 and n + 2 not in got


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = near_groups(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == {d: brute_fingerprint(t) for d, t in texts.items()}
    rank = {}
    for r in got:
        f = int(r.fingerprint, 16)
        rank[f] = min(rank.get(f, r.doc_id), r.doc_id)
    want = brute_components(rank)
    assert all(r.component_id == want[int(r.fingerprint, 16)] for r in got)
    ids = {(r.doc_id, r.component_id) for r in near_groups(odd).collect()}
    assert {(3, 3), (4, 3), (5, 3), (2, 1), (7, 1), (None, None)} <= ids
    assert near_groups(nothing).count() == 0


def test_unrelated_texts_under_no_id_or_one_id_all_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    t = [" ".join(word() for _ in range(400)) for _ in range(6)]
    near = [next(x for i in range(400) if (x := " ".join([*y.split()[:i], "changed", *y.split()[i + 1 :]])) and 0 < (fingerprint(x) ^ fingerprint(y)).bit_count() <= 2) for y in (t[1], t[3])]
    rows = [(None, t[0]), (None, t[1]), (None, near[0]), (5, t[2]), (5, t[3]), (5, near[1]), (6, t[4]), (None, t[4]), (7, t[5])]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shared_dir(spark))
    got = one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text not in (t[1], near[0], t[3], near[1])) == sorted([(0, t[0]), (5, t[2]), (6, t[4]), (7, t[5])])
    assert sum(r.text in (t[1], near[0]) for r in got) == 1 == sum(r.text in (t[3], near[1]) for r in got)

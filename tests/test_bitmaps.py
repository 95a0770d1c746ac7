import random

from tidemark.operators.bitmaps import bitmaps, merged, overlaps


def test_overlaps_are_those_of_sets(spark):
    rng = random.Random(6)
    sets = {c: {rng.randint(0, 90_000) for _ in range(n)} for c, n in (("a", 3_000), ("b", 5_000), ("c", 1))} | {"d": {0, 32_767, 32_768, 32_769, 65_536}}
    sets["b"] |= set(list(sets["a"])[:900])
    rows = [(c, i) for c, s in sets.items() for i in s for _ in range(1 + i % 2)] + [("a", None), ("a", -5), ("e", None)]
    df = spark.createDataFrame(rows, "s string, id long")
    one = bitmaps(df, "s", "id")
    got = {(r.a, r.b): (r.n_a, r.n_b, r.n_both, r.overlap) for r in overlaps(one, one, "s").collect()}
    assert got == {(x, y): (len(a), len(b), len(a & b), len(a & b) / len(a | b)) for x, a in sets.items() for y, b in sets.items()}
    days = bitmaps(df.where("id % 2 = 0"), "s", "id").unionByName(bitmaps(df.where("id % 3 < 2"), "s", "id"))  # of two days that overlap
    assert {(r.a, r.n_a) for r in overlaps(merged(days, "s"), one, "s").collect()} == {(x, sum(i % 2 == 0 or i % 3 < 2 for i in a)) for x, a in sets.items() if any(i % 2 == 0 or i % 3 < 2 for i in a)}

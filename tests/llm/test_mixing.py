from collections import defaultdict
from fractions import Fraction

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.dedup_stream import deduplicated
from tidemark.llm.mixing import _mix, _running, mix, mixed, targets
from tidemark.llm.shared import located, settings as conf, shared_dir, written
from tidemark.llm.simhash import one_of_each


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total = Fraction(sum(sizes.values()))
    free, out, left = set(names), {}, total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = Fraction(3 * sizes[s])
            left -= out[s]
        free -= over
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.none() | st.sampled_from(["", "a", "B", "é", "\U0001f600", "￮", "z", "zz", "b"]), st.sampled_from([0, 1, 2, 5, 100, 1000]), min_size=1))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_targets_of_many_sources_in_ranges(spark):
    sizes = {f"host-{i:05d}": (i * i) % 97 * (1000 if i % 50 == 0 else 1) for i in range(4000)} | {None: 12, "": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    with conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}):
        got = {r.source: r.target for r in targets(df).collect()}
        folder = shared_dir(spark)
        rows = _running(df, [F.col("source").isNull(), F.col("source")], {"before": F.lit(1), "sum": F.col("source_size")}, folder).collect()
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    rows.sort(key=lambda r: (r.source is None, r.source))
    assert [r.before for r in rows] == list(range(4002)) and all(b.sum == a.sum + a.source_size for a, b in zip(rows, rows[1:], strict=False))
    most = spark.read.parquet(folder).groupBy("_range").count().agg(F.count("*"), F.max("count")).first()
    assert most[0] > 8 and most[1] < 1000


def test_one_hot_source_among_many(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 5 AS INT)) AS text", "IF(id % 3 = 0, NULL, concat('h', id)) AS source")
    check(docs, mix(docs).collect())


def check(docs, rows):
    texts = docs.collect()
    size = lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for r in texts:
        by[r.source] += size(r.text)
    want = brute_targets(by)
    assert sorted((str(r.doc_id), size(r.text), by[r.source], round(float(want[r.source]), 3)) for r in texts) == sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 3)) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.cut_to for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source_size, round(r.target, 3)] += r.taken
    for key in taken:
        want_sum = sum(float(want[s]) for s in by if (by[s], round(float(want[s]), 3)) == key)
        assert abs(taken[key] - want_sum) <= 0.51 * len(by)


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for fan_in in (64, 4):
        rows = mix(docs, fan_in=fan_in).collect()
        check(docs, rows)
        again = mix(docs.repartition(3), fan_in=fan_in)
        assert sorted(r[:7] for r in rows) == sorted(tuple(r) for r in again.collect())
    check(odd, mix(odd).collect())
    assert mix(nothing).count() == 0


def test_expected_mass_is_kept(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i < 60 else "b") for i in range(90)], "doc_id long, text string, source string")
    total = defaultdict(float)
    for seed in range(12):
        for r in mix(docs, seed=seed, fan_in=8).collect():
            total[r.source_size, r.size] += r.taken / 12 / r.size
    times = {r.source_size: r.target / r.source_size for r in mix(docs).collect()}
    n = defaultdict(int)
    for r in mix(docs).collect():
        n[r.source_size, r.size] += 1
    assert all(abs(total[k] / n[k] - times[k[0]]) < 0.25 for k in n)


def test_rows_of_the_mix(spark, sf):
    docs = written(spark.read.parquet(f"{sf}/documents.parquet"), shared_dir(spark))
    plan = mix(docs).collect()
    got = defaultdict(int)
    for r in mixed(docs).collect():
        got[r.doc_id] += len(regex.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {r.doc_id: r.taken for r in plan if r.taken} == got and mixed(docs).columns == docs.columns


def test_many_rows_of_one_id_and_text_spread_over_blocks(spark):
    docs = written(spark.range(12_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "IF(id % 4 = 0, 'a b', 'a b c') AS text", "IF(id % 10 < 7, 's', 't') AS source"), shared_dir(spark))
    rows = mix(docs).collect()
    check(docs, rows)
    folder = shared_dir(spark)
    _mix(located(docs, folder), folder, (1, 2, 3), 0)
    most = spark.read.parquet(f"{folder}/level-0").selectExpr("max(size(done))").first()[0]
    assert most < 64 * 3
    assert sorted(tuple(r) for r in mix(docs).collect()) == sorted(map(tuple, rows))


def test_a_scan_that_is_cut_anew_gives_the_same_rows(spark):
    """Another number of cores, as after the loss of an executor, between the writing of places and their use."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 3000, ' ', repeat('w ', CAST(id % 3000 % 9 AS INT))) AS text", "concat('s', id % 3) AS source", "'keep' AS _place", "'keep' AS copies", "7 AS n")
    folder = shared_dir(spark)
    docs.repartition(40).write.parquet(folder)
    results = []
    for cuts in ((4, 4), (4, 16)):
        with conf(spark, {"spark.sql.files.minPartitionNum": str(cuts[0])}):
            docs = spark.read.parquet(folder)
            out = [deduplicated(docs), mixed(docs), one_of_each(docs)]
        with conf(spark, {"spark.sql.files.minPartitionNum": str(cuts[1])}):
            results.append([sorted(map(tuple, df.collect())) for df in out])
    assert results[0] == results[1] and len(results[0][0]) == 3000 == len({r[1] for r in results[0][0]})
    assert all(r[3] == r[4] == "keep" and r[5] == 7 for rows in results[0] for r in rows)

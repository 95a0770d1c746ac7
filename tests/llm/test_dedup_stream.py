import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm.dedup_stream import ExactDeduplicator, deduplicated, differing, exact_groups, sha256
from tidemark.llm.shared import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    known = lambda d: -(2**63) if d is None else d
    return sorted((known(d), known(max(ids, key=known)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)


def found(df):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, -(2**63) if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = exact_groups(docs)
    assert found(out) == brute(docs.collect())
    assert out.where("kept").count() == out.where("doc_id = keep_id").count() == out.select("text_sha256").distinct().count()


def test_odd_rows(odd, nothing):
    out = exact_groups(odd)
    assert found(out) == brute(odd.collect())
    assert {(r.doc_id, r.group_size) for r in out.where("kept").collect()} == {(5, 1), (4, 2), (None, 1), (6, 1), (7, 4), (8, 1), (9, 1)}
    twice = exact_groups(odd.where("doc_id = 2"))
    assert twice.count() == 2 and twice.where("kept").count() == 1
    assert exact_groups(nothing).count() == 0


def test_state_goes_on_over_batches_and_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = shared_dir(spark)
    dedup = ExactDeduplicator(spark, folder)
    dedup.observe(docs.where("doc_id % 2 = 0").repartition(5), batches=3)
    assert len({r.version for r in spark.read.parquet(dedup.versions).select("version").distinct().collect()}) == 3
    dedup.observe(docs.where("doc_id % 2 = 1"))
    got = {(r.digest.hex(), r.kept.doc_id, r.group_size) for r in dedup.groups().collect()}
    assert got == {(t, k, n) for _, k, n, t in brute(docs.collect())}


def test_a_folder_that_is_kept_holds_one_row_a_text(spark, odd):
    folder = shared_dir(spark)
    first = spark.createDataFrame([(5, "a"), (5, "b"), (7, None)], "doc_id long, text string")
    second = spark.createDataFrame([(5, "A"), (6, "b"), (3, "")], "doc_id long, text string")
    assert exact_groups(first, folder).count() == 3
    got = exact_groups(second, folder)
    assert found(got) == brute(first.collect() + second.collect())
    stays = Counter(r.text_sha256 for r in got.where("kept").collect())
    assert len(stays) == 3 and set(stays.values()) == {1}


def test_a_run_that_broke_off_is_written_over(spark):
    folder = shared_dir(spark)
    dedup = ExactDeduplicator(spark, folder)
    spark.createDataFrame([(1, 1)], "doc_id long, at long").write.parquet(f"{dedup.inbox}/run=0")
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert found(exact_groups(docs, folder)) == brute(docs.collect())


WEAK = lambda text: F.unhex(F.sha2(F.substring(text, 1, 1).cast("binary"), 256))


def test_texts_of_one_digest_are_told_apart_by_their_bytes(spark):
    folder = shared_dir(spark)
    one = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB"), (4, "x")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "ac"), (5, "ab"), (6, None), (7, "x")], "doc_id long, text string")
    exact_groups(one, folder, digest=WEAK)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(two, folder, digest=WEAK).collect()}
    assert got == {(1, 5, 3, False), (3, 5, 3, False), (5, 5, 3, True), (2, 9, 2, False), (9, 9, 2, True), (4, 7, 2, False), (7, 7, 2, True), (6, 6, 1, True)}


def test_bytes_are_compared_with_those_of_an_earlier_run(spark):
    dedup = ExactDeduplicator(spark, shared_dir(spark), WEAK)
    dedup.observe(spark.createDataFrame([(9, "ab")], "doc_id long, text string"))
    dedup.observe(spark.createDataFrame([(1, "ac"), (2, "AB")], "doc_id long, text string"))
    assert [(r.run, r.doc_id) for r in differing(dedup.texts(), dedup.groups()).collect()] == [(1, 1)]


def test_the_rows_that_stay_have_all_their_columns(spark):
    rows = [(1, "a", "keep", 1, None), (2, "A", "keep", 2, "x"), (None, "b", "keep", 3, "y"), (None, "b", "keep", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, at int, `odd name` string").withColumn("_place", F.lit("keep")).withColumn("run", F.lit(8))
    got = deduplicated(docs)
    assert got.columns == docs.columns and {r.at for r in got.collect()} <= {2, 3, 4} and got.count() == 2
    assert all(r.place == r._place == "keep" and r.run == 8 for r in got.collect())


def test_more_digests_than_are_broadcast(spark, monkeypatch):
    """One hot text among many pairs: the joined way finds the same groups."""
    rows = [(i, "Hot TEXT" if i % 3 else f"pair {i // 6}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in exact_groups(docs).collect())
    monkeypatch.setattr("tidemark.llm.dedup_stream.BROADCAST_DIGESTS", 0)
    assert sorted(tuple(r) for r in exact_groups(docs).collect()) == want
    shared = lambda c: F.substring(sha256(c), 1, 1)  # noqa: E731  texts that differ under one digest
    assert sorted(tuple(r)[:4] for r in exact_groups(docs, digest=shared).collect()) == [x[:4] for x in want]

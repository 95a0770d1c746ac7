from collections import Counter

from tidemark.llm.rules import Fertility, judged
from tidemark.llm.shared import shared_dir, words, working_in, written


def applied(spark, docs, upto):
    import corpus_pipeline

    out = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:upto]):
        docs = written(stage(spark, docs, ""), f"{shared_dir(spark)}/{n}")
        out.append(docs)
    return out


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_stages(spark, sf):
    from test_simhash import brute_components, brute_fingerprint

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules, exact, near, mix, packed = applied(spark, docs, 5)
    assert all(d.columns == docs.columns for d in (rules, exact, near, mix))
    rows = docs.collect()
    want = [r for r, v in zip(rows, judged([r.text for r in rows], Fertility())) if v[6]]
    assert sorted(rules.collect()) == sorted(want)
    last = {}
    for r in sorted(want, key=lambda r: r.doc_id):
        last[lower(r.text)] = r
    assert sorted(exact.collect()) == sorted(last.values())
    rank = {}
    for r in last.values():
        f = brute_fingerprint(r.text)
        rank[f] = min(rank.get(f, r.doc_id), r.doc_id)
    stays = set(brute_components(rank).values())
    assert sorted(near.collect()) == sorted(r for r in last.values() if r.doc_id in stays)
    total = sum(len(words(r.text)) for r in near.collect())
    assert abs(sum(len(words(r.text)) for r in mix.collect()) - total) <= near.select("source").distinct().count()
    assert max(Counter(r.doc_id for r in mix.collect()).values()) <= 3
    starts = packed.where("start = 0").collect()
    assert Counter(r.doc_id for r in starts) == Counter(r.doc_id for r in mix.collect())


def test_odd_rows(spark, odd, nothing):
    assert [d.count() for d in applied(spark, written(nothing, shared_dir(spark)), 5)] == [0] * 5
    rules, exact, near, _, _ = applied(spark, written(odd, shared_dir(spark)), 5)
    assert [r.doc_id for r in exact.collect()] == [7] == [r.doc_id for r in near.collect()] and rules.count() == 4
    assert near.columns == odd.columns


def test_a_run_clears_what_it_no_longer_reads(spark, sf, tmp_path):
    import corpus_pipeline

    with working_in(f"file://{tmp_path}"):
        pieces = corpus_pipeline.run(spark, sf)
    (last,) = (p for p in tmp_path.rglob("*") if p.name.startswith(("stage-", "work-")))
    mix = spark.read.parquet(f"file://{last}")
    assert last.name == "stage-3" and mix.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert pieces.where("start = 0").count() == mix.count() > 0
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

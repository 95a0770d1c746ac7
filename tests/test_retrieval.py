import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nearest as module
from tidemark.operators.nearest import nearest
from tidemark.operators.retrieval import KeptIndex, bm25


def test_nearest_in_blocks_is_that_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(40)]  # ties
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None]), (904, [float("nan")] * 8), (905, [1.0, 2.0]), (906, [float("inf")] * 8)]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>")
    q = v.where("doc_id % 20 = 0 OR doc_id > 899").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    want = []
    fine = {i: np.array(x) for i, x in rows if x and None not in x and np.isfinite(x).all() and np.any(x)}
    for i, a in fine.items():
        if i % 20 == 0 or i > 899:
            s = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), j) for j, b in fine.items() if len(a) == len(b))
            want += [(i, j, -x, n) for n, (x, j) in enumerate(s[:5], 1)]
    for sizes in ((32_768, 2_048), (50, 7)):
        monkeypatch.setattr(module, "VECTORS", sizes[0])
        monkeypatch.setattr(module, "QUERIES", sizes[1])
        got = nearest(v, q, 5)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert nearest(v.where("doc_id = 902"), q, 5).count() == 0 and nearest(v, q.where("false"), 5).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = ["the integration is late again", "prices went up and integration failed", "", "late late deliveries, late integration", "nothing to see", "prices of integrations", None]
    docs = spark.createDataFrame([(f"d{i}", texts[i % 7], i % 3) for i in range(60)], "doc_id string, text string, g int").withColumn("text", F.coalesce("text", F.lit("")))
    index = KeptIndex(spark, str(tmp_path_factory.mktemp("index") / "i"))
    for version in (0, 1, 2, 1):  # one comes twice
        index.add(docs.where(F.col("g") == version), version)
    return docs, index, spark.createDataFrame([(1, "late integration"), (2, "prices"), (3, "zzz")], "query_id int, query string")


def _scores(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in df.collect())


def test_the_index_scores_as_the_texts_do(corpus):
    docs, index, queries = corpus
    assert _scores(index.search(queries)) == _scores(bm25(docs.drop("g"), queries)) != []
    some = docs.where("g < 2 AND doc_id <> 'd3'")  # counts and lengths are those of the scope
    assert _scores(index.search(queries, some)) == _scores(bm25(some.drop("g"), queries)) != _scores(index.search(queries))
    assert index.search(queries, docs.where("false")).count() == 0


def test_a_search_reads_no_text_and_few_parts(spark, corpus):
    docs, index, queries = corpus
    plan = index.search(queries)._jdf.queryExecution().executedPlan().toString()
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert read and not any("text" in x or "words" in x for x in read) and "postings" in plan and re.search(r"PartitionFilters: \[.*part", plan)

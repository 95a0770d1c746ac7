"""Tables that have rows, but nothing in them: every operator gives one row each, or no phrase, and doesn't crash."""

import pytest

import corpus_pipeline
from tidemark.llm.dedup_stream import exact_groups
from tidemark.llm.language import identify
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.phrases import collocations
from tidemark.llm.pii import personal_data
from tidemark.llm.ppm import scores
from tidemark.llm.repeats import without_repeats
from tidemark.llm.resampling import resampled
from tidemark.llm.rules import quality
from tidemark.llm.separators import token_counts
from tidemark.llm.simhash import near_groups

TEXTS = {
    "null": [None] * 9,
    "one of each": [None, "", " ", "\n\n", ".", "a", "\x00", " ", "é"],
}
EACH = {
    "op2": mix,
    "op3": personal_data,
    "op4": exact_groups,
    "op5": identify,
    "op6": without_repeats,
    "op6 in blocks": lambda d: without_repeats(d, block_bytes=2),
    "op7": near_groups,
    "op8": quality,
    "op9": token_counts,
    "op10": scores,
    "op10 in blocks": lambda d: scores(d, block_bytes=2),
    "op12": lambda d: resampled(d, d.select("text")),
}


@pytest.fixture(scope="module", params=TEXTS)
def docs(request, spark):
    rows = [(i if i else None, t, None, None) for i, t in enumerate(TEXTS[request.param])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("op", EACH)
def test_a_row_each(docs, op):
    got = EACH[op](docs).collect()
    assert len(got) == 9 and {r.doc_id for r in got} == {None, *range(1, 9)}


def test_pieces(docs):
    assert {r.doc_id for r in pack(docs).collect()} == {None, *range(1, 9)}


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_no_phrase(docs, block):
    assert collocations(docs, block_bytes=block).count() == 0


def test_pipeline(docs, tmp_path):
    """The rules reject all of these."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(docs.sparkSession, str(tmp_path)).count() == 0

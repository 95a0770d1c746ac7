"""Texts of some MB beside short ones: what stands at their very end counts, as whole texts are read."""

import hashlib

import pytest

from tidemark.llm.dedup_stream import exact_groups
from tidemark.llm.language import identify
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.pii import personal_data
from tidemark.llm.ppm import scores
from tidemark.llm.repeats import without_repeats

#: 3 MB without a passage of 50 bytes that repeats, and one of 4 MB without a blank.
NUMBERS = " ".join(f"{i:x}q{i * 7919:x}" for i in range(210_000))
SOLID = "x" * 4_000_000
END = " and this is the passage of over fifty bytes that stands in both of the long texts"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)


def test_packing(spark):
    rows = pack(_docs(spark, [NUMBERS, "short", SOLID])).collect()
    for d in range(3):
        mine = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == d)
        at = 0
        for start, length, _ in mine:
            assert start == at and 0 < length <= 4096
            at += length
        assert {n for _, _, n in mine} == {at}
    assert len([r for r in rows if r.doc_id == 0]) > 100


def test_mixing(spark):
    got = {r.doc_id: r for r in mix(_docs(spark, [NUMBERS, "two words", SOLID])).collect()}
    assert [got[i].size for i in range(3)] == [210_000, 2, 1]
    assert all(0 <= r.taken <= 3 * r.size for r in got.values()) and abs(sum(r.taken for r in got.values()) - 210_003) <= 1


def test_personal_data(spark):
    mail = "someone.else@example.org"
    got = {r.doc_id: r for r in personal_data(_docs(spark, [f"{NUMBERS} {mail}", mail, SOLID, f"{SOLID}@example.org"])).collect()}
    at = len(NUMBERS) + 1
    assert f"email:{at}:{at + len(mail)}" in got[0].spans.split(",") and got[1].n_email == 1 and got[2].n_email == 0
    assert got[3].base_sha256 == hashlib.sha256(f"email:0:{len(SOLID) + 12}".encode()).hexdigest()


def test_exact_dedup(spark):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(_docs(spark, [NUMBERS + "a", NUMBERS + "A", NUMBERS + "b", SOLID])).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1)}


def test_language(spark):
    english, german = "the cat and the dog are in the house ", "der hund und die katze sind im haus "
    short = [english if i % 2 else german for i in range(60)]
    docs = _docs(spark, [*short, german * 60_000, english * 60_000, SOLID])
    got = {r.doc_id: r.lang_pred for r in identify(docs).collect()}
    assert (got[60], got[61]) == ("de", "en") and got[62] in ("de", "en")


@pytest.mark.parametrize("block", [None, 1 << 20])
def test_repeats(spark, block):
    docs = _docs(spark, [NUMBERS + END, "z" * 60, "0" * 2_000_000 + END, SOLID, SOLID])
    more = {} if block is None else {"block_bytes": block}
    got = {r.doc_id: r for r in without_repeats(docs, **more).collect()}
    assert [got[i].n_removed for i in range(5)] == [0, 0, len(END), 0, len(SOLID)] and [got[i].n_spans for i in range(5)] == [0, 0, 1, 0, 1]
    assert got[2].kept_sha256 == hashlib.sha256(b"0" * 2_000_000).hexdigest()


def test_scores(spark):
    got = {r.doc_id: r for r in scores(_docs(spark, [NUMBERS, "two words", SOLID, ""])).collect()}
    assert [got[i].n_tokens for i in range(4)] == [210_001, 3, 2, 1] and got[0].score < got[1].score < 0
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())

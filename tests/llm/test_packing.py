import zlib

import numpy as np
import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import cuts, pack
from tidemark.llm.tokens import ChunkEncoder


@given(st.integers(1, 20_000))
def test_cuts_cover_and_fit_their_class(n):
    got = cuts(n)
    assert sum(s for s, _ in got) == n
    assert all(4096 // (k + 1) < s <= 4096 // k for s, k in got)


@settings(deadline=None, max_examples=60)
@given(st.text(max_size=300) | st.text(alphabet="aeE'stÉß ,.1\u0301\u0130\u03a3κ<|>\x1c\xa0\n", max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "A", "é", " ", "\u0301", "1", "İ"]), max_size=9).map("".join))
@example("e\u0301t\u0301 naïve's'll ÀÉ.x <|endoftext|> 12,3")
def test_chunks_encode_as_the_whole_text(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for special in (True, False):
        t.encode_special_tokens = not special
        assert next(ChunkEncoder(special=special, chunks=99).encode([text])) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_in_a_text_are_themselves(spark):
    texts = ["a <|endoftext|> b", "A<|startoftext|>É<|ENDOFTEXT|> B <|endoftext|>", "<|endoftext"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.ids_crc32, r.length) for r in pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).where("start = 0").collect()}
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert 49407 in want[0] and all(got[i][0] == zlib.crc32(ids[: got[i][1]].tobytes()) for i, ids in enumerate(want))


def packed(df):
    return pack(df).toPandas()


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p, t = packed(docs), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, of in p.sort_values("start").groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert list(of.start) == [0, *of.length.cumsum()[:-1]] and of.length.sum() == len(ids) == of.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(of.start, of.length)] == list(of.ids_crc32)
    assert set(p.doc_id) == set(texts)
    pad = 0
    for _, of in p.sort_values("offset").groupby("sequence_id"):
        assert list(of.offset) == [0, *of.length.cumsum()[:-1]]
        n = of.length.sum()
        assert n <= 4096
        pad += 0 if n & (n - 1) == 0 else 4096 - n
    assert pad < 0.01 * p.length.sum()


def test_odd_rows(odd, nothing):
    p = packed(odd)
    starts = p[p.start == 0]
    assert len(starts) == 11 and (starts.doc_id == 2).sum() == 2 and starts.doc_id.isna().sum() == 1
    assert set(starts[starts.doc_id.isin([3, 4, 5])].doc_tokens) == {1}
    assert len(packed(nothing)) == 0

from collections import Counter

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import rules
from tidemark.llm.rules import base_counts, filtered, judged, quality, script_of
from tidemark.llm.shared import words


def brute(text):
    text = text or ""
    w = regex.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if regex.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", text)), dup, len(cover)


@given(st.lists(st.sampled_from(["a", "b", "c#", "\n", " ", "\t", " ", "\x1c", "é|", "a b a b a b"]), max_size=60))
def test_base_counts(parts):
    text = " ".join(parts)
    assert base_counts(text, words(text)) == brute(text)


def test_long_texts_take_the_way_by_arrays(monkeypatch):
    rng = np.random.default_rng(1)
    w = [str(x) for x in rng.integers(0, 9, 3000)]
    exact = rules.covered_by_repeats(w)
    monkeypatch.setattr(rules, "LONG", 10)
    assert rules.covered_by_repeats(w) == exact > 0


@settings(deadline=None)
@given(st.lists(st.text(alphabet="abcdeé.,#\u2581\u0301漢½ﬁ²\xa0Zß!", min_size=1, max_size=8), min_size=1, max_size=20))
def test_words_encoded_at_once_have_their_own_ids(several):
    fertility = rules.Fertility()
    fertility._learn(set(several))
    assert {w: np.frombuffer(b, "<u2").tolist() for w, b in fertility.ids.items()} == {w: fertility.model.encode(w) for w in several}


def test_scripts():
    assert [rules.SCRIPTS[script_of(x)] for x in ("abc", "где", "漢字", "123", "ไทย")] == ["LATIN", "CYRILLIC", "CJK", "", "OTHER"]


def test_verdicts():
    prose = "It was a bright cold day in April and the clocks were striking thirteen when he slipped quickly through the glass doors of the building"
    one_word = " ".join(["aaaa", "bbbb"] * 40)
    noise = " ".join("".join(chr(0x2800 + (i * 7 + j) % 255) for j in range(6)) for i in range(30)) + " a"
    assert [r[6] for r in judged([prose, one_word, noise, None, "1 2 3 4 5 6 7 8 9 10 11 12"], rules.Fertility())] == [True, False, False, False, False]


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute(r.text)
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.base_failed and g.kept)
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()
    kept = [got[r.doc_id].kept for r in clean if r.doc_id in got and not got[r.doc_id].base_failed]
    assert kept and all(kept)
    assert quality(odd).count() == 11 and quality(nothing).count() == 0 and filtered(nothing).count() == 0
    assert filtered(odd).columns == odd.columns and {r.doc_id for r in filtered(odd).collect()} == {1, 2, 7}


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    verdicts = [(r.quality, v[6]) for r, v in zip(labelled, judged([r.text for r in labelled], rules.Fertility())) if not v[5]]
    junk, clean = ([kept for quality, kept in verdicts if quality == q] for q in (0, 1))
    assert len(junk) > 20 and len(clean) > 200
    assert np.mean(junk) < 0.3 and np.mean(clean) > 0.99


def test_measures_are_those_of_the_whole_text(spark):
    """With one space for each run of blanks: this vocabulary spells line ends as bytes."""
    fertility = rules.Fertility()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text and len(r.text) < 20_000]
    for text, (*_, n, chars, share, bits, _) in zip(texts, judged(texts, fertility)):
        ids = np.array(fertility.model.encode(" ".join(words(text))), int)
        p = np.bincount(ids)[np.unique(ids)] / max(1, len(ids))
        assert n == len(ids)
        assert not n or np.allclose((chars, share, bits), (sum(map(len, words(text))) / n, fertility.byte_ids[ids].mean(), -(p * np.log2(p)).sum()))

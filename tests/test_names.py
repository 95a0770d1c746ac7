import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.names import LONGEST, without_names


def _alias(i):
    return "Account " + hashlib.sha256(str(i).encode()).hexdigest()[:4]


def plain(text, names):
    """The first match at each place, the longest of those, by trying every name."""
    if text is None:
        return None
    out, at = "", 0
    word = re.compile(r"\w")
    while at < len(text):
        best = None
        for gram, i in names.items():
            end = at + len(gram)
            touches = (at and word.match(text[at - 1])) or (end < len(text) and word.match(text[end]))
            if text[at:end].lower() == gram and not touches and (best is None or len(gram) > len(best[0])):
                best = (gram, i)
        if best:
            out, at = out + _alias(best[1]), at + len(best[0])
        else:
            out, at = out + text[at], at + 1
    return out


NAMES = [(1, "ACME"), (1, "Acme Corp."), (2, "Acme Corp. Europe"), (3, "Café Zürich"), (4, " --Blue-Sky, Ltd! "), (5, "Europe"), (7, "acme"), (8, "???"), (9, None), (3, "x_1")]


def test_names_are_replaced_longest_and_leftmost(spark):
    names = {"acme": 1, "acme corp": 1, "acme corp. europe": 2, "café zürich": 3, "blue-sky, ltd": 4, "europe": 5, "x_1": 3}
    rng = random.Random(8)
    words = ["acme", "Acme", "Corp", ".", " ", ". ", "Europe", "EUROPE", "Café", "Zürich", "blue", "-", "Sky", ", ", "LTD", "x_1", "_", "acmes", "1", "\n"]
    texts = ["", None, "ACME", "acme_corp acme-corp", "Acme Corp. Europe and Acme Corp and Europe", "no names here"] + ["".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, "acme", 6)], "id long, text string, gram int")
    got = without_names(df, spark.createDataFrame(NAMES, "account_id long, name string"))
    assert got.columns == df.columns
    assert sorted((r.id, str(r.text), r.gram) for r in got.collect()) == sorted([(i, str(plain(t, names)), 5) for i, t in enumerate(texts)] + [(0, _alias(1), 6)])


def test_a_table_of_many_names(spark):
    names = spark.range(100_000).select(F.col("id").alias("account_id"), F.concat(F.lit("Firm "), F.col("id").cast("string"), F.lit(" & Sons")).alias("name"))
    docs = spark.createDataFrame([(i, f"paid by firm {i * 7} & sons, not by Firm {i * 7} & Son") for i in range(500)], "id long, text string")
    got = {r.id: r.text for r in without_names(docs, names).collect()}
    assert got == {i: f"paid by {_alias(i * 7)}, not by Firm {i * 7} & Son" for i in range(500)}


def test_no_names_and_names_that_are_too_long(spark):
    docs = spark.createDataFrame([(1, "acme")], "id long, text string")
    none = spark.createDataFrame([(1, "?")], "account_id long, name string")
    assert without_names(docs, none).first().text == "acme"
    with pytest.raises(ValueError, match="more than"):
        without_names(docs, spark.createDataFrame([(1, "a " * LONGEST)], "account_id long, name string"))
    assert without_names(docs, spark.createDataFrame([(1, "acme")], "account_id long, name string"), replacement=F.lit("[restricted]")).first().text == "[restricted]"

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts, languages and sources; empty, blank and repeated rows; a column that clashes."""
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door again", "en", "a", 5),
        (2, "the cat sat on the mat and the dog lay by the door again", "en", "a", 5),
        (2, "the cat sat on the mat and the dog lay by the door again", "en", "a", 5),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "de", "b", 4),
        (None, "a null id " * 30, "en", None, None),
        (6, "word " * 30_000, "en", "c", 150_000),
        (7, "THE cat sat on the mat and the dog lay by the door again", None, "a", 5),
        (8, "x" * 5_000, "fr", "b", 5_000),
        (9, "naïve été \U0001f600 12345 ###", "fr", "b", 20),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS block", "2 AS sequence_id", "'k' AS key", "0 AS size", "true AS kept", "9 AS fp")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

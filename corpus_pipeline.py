"""A corpus from documents to training sequences: rules, exact and near duplicates, mixing, packing.

Every stage takes a null text as the empty one, keeps all columns whatever they are called (but for the last, whose rows are
pieces), takes rows that repeat as rows of their own, and of an empty table makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.dedup_stream import deduplicated
from tidemark.llm.mixing import mixed
from tidemark.llm.packing import pack
from tidemark.llm.rules import filtered
from tidemark.llm.shared import WIDE_ROWS, removed, shared_dir, working_in, written
from tidemark.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of operator 8 reject go, each judged alone: null, empty and blank texts have too few words and go; repeated rows and null ids share no fate."""
    return filtered(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays; null ids are the least, and of rows that tie, the last by place stays. Null and empty texts are equal."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints, the one with the smallest doc_id stays; null ids are the greatest, and of rows that tie, the first by place stays. Texts without a word are linked."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times, and one of a source cut at a word. Null sources are one source, texts without a word aren't taken, rows that repeat are drawn each."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences: a null or empty text is its end alone, a null id stays null, repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The vocabulary of the rules and of packing, and random rounding, have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and reread.

    Once a stage's rows are written, its own tables and the rows of the stage before go, so the folder never holds more
    than two stages' rows and one stage's tables. The last stage is read from the rows of the one before.
    """
    folder, docs = shared_dir(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with working_in(f"{folder}/work-{n}"):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/stage-{n}", WIDE_ROWS)
        for done in (f"{folder}/work-{n}", f"{folder}/stage-{n - 1}"):
            removed(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)

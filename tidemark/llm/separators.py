"""Operator 9: token counts of documents in flat token files without an index, by scanning for separators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import exists, on_workers, settings, shared_dir, written
from tidemark.llm.tokens import VOCABULARY, encoder

#: Ids of word_bpe_49k.json, all under 2**16: two bytes an id, little-endian; documents end with <|endoftext|>.
DTYPE = "<u2"
END = 49407
#: Bytes of a block.
BLOCK = 1 << 20
#: Blocks of a file that are scanned together; their sums are scanned over the file.
GROUP = 1024
#: Bytes that a task reads of raw files, about.
TASK = 1 << 26

BLOCKS = "file string, block long, ids binary"
#: Rows that end with the two bytes of END.
ROWS = {"encoding": "ISO-8859-1", "lineSep": END.to_bytes(2, "little").decode("ISO-8859-1")}
#: Paths that Arrow's file systems open as they are.
RANGED = "(file|hdfs|s3|gs|abfss?):"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> tuple[str, DataFrame] | None:
    """Writes the ids of all documents one after the other, each followed by END, to flat binary files, one for each task.

    Spark's writer of text makes the files, with the mark's two bytes as the separator of its rows, so they are committed as any
    table's. Returns the files' folder and, apart from them, which document is where: file (its name), first (its first
    document's ordinal), doc_ids. Null texts are empty; None where there is no row.
    """
    spark = docs.sparkSession
    on_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(vocabulary, DTYPE, special=False), 0
        row = lambda kind, value: pa.RecordBatch.from_arrays([pa.array([value], pa.binary()), pa.array([kind])], ["value", "kind"])
        for batch in batches:
            for ids in encode.encode(t or "" for t in batch.column("text").to_pylist()):
                yield row("tokens", ids)
            doc_ids = batch.column("doc_id").to_pylist()
            if doc_ids:
                yield row("documents", f"{first}:{','.join('' if d is None else str(d) for d in doc_ids)}".encode())
            first += len(doc_ids)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "value binary, kind string")
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):  # a task writes both files as it goes, in the order of its rows
        rows.select(F.col("value").cast("string"), "kind").write.partitionBy("kind").options(**ROWS).text(folder)
    if not exists(spark, f"{folder}/kind=documents"):
        return None
    read = spark.read.options(**ROWS).text(f"{folder}/kind=documents")
    parts = F.split("value", ":")
    ids = F.transform(F.split(parts[1], ","), lambda x: F.nullif(x, F.lit("")).cast("long"))
    return f"{folder}/kind=tokens", read.select(read.metadataColumn("_metadata")["file_name"].alias("file"), parts[0].cast("long").alias("first"), ids.alias("doc_ids"))


def token_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The blocks of flat token files, by byte range where Arrow opens such a path, else through Spark's reader of whole files."""
    return ranged_blocks(spark, path, block) if re.match(RANGED, path) else raw_blocks(spark, path, block)


def ranged_blocks(spark: SparkSession, path: str, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """The blocks of raw binary token files at path (a file, folder or glob), of any size, each read by its byte range.

    Spark lists the files; the tasks open them through Arrow's file systems (local, HDFS, S3, GCS, Azure).
    """
    on_workers(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # no content is read
    total = files.agg(F.sum("length")).first()[0] or 0
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != name:
                    name = r["path"]
                    store, at = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                    opened = store.open_input_file(at)
                start = r["block"] * block
                ids = opened.read_at(min(block, r["length"] - start), start)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r["block"]], pa.int64()), pa.array([ids], pa.binary())], ["file", "block", "ids"])

    dealt = ranges.repartition(max(1, -(-total // task)), "path", F.floor(F.col("block") * block / task))
    return dealt.mapInArrow(run, BLOCKS)


def raw_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """As ranged_blocks(), for stores that only Spark's readers reach: files of under 2 GB each, Spark's limit for a value, read whole."""
    on_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                view = content.as_buffer()
                for n, at in enumerate(range(0, view.size, block)):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([n]), pa.array([view.slice(at, min(block, view.size - at)).to_pybytes()], pa.binary())], ["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, end: int = END, dtype: str = DTYPE, group: int = GROUP) -> DataFrame:
    """One row a document: file, ordinal (in the file), start (its first id's place in the file), n_tokens
    without the separator, and ended, false for ids after the last separator of a file.

    Each block is searched alone. What a block adds to the count of ids and of separators, and its last
    separator's place, then go through a prefix scan over the file's blocks, a row a block, so a document may
    reach over any number of blocks. The scan has two levels, groups of blocks and the groups of a file, so
    a file of any size is scanned by many tasks. Empty documents count 0. No block, no result.
    """
    on_workers(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column("ids")]
            ends = [np.flatnonzero(x == end) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(map(len, ids), pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"]
            )

    found = blocks.select("file", "block", "ids").mapInArrow(run, "file string, block long, n_ids long, ends array<long>")
    found = written(found, f"{shared_dir(blocks.sparkSession)}/ends").withColumn("group", F.floor(F.col("block") / group))
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = found.select("file", "group", "block", "n_ids", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last_end"))
    inside = inside.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("last", F.col("base") + F.col("last_end"))
    of_group = inside.groupBy("file", "group").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max("last").alias("last"), F.max("block").alias("top"))
    order = Window.partitionBy("file").orderBy("group")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    of_group = of_group.withColumn("g_base", F.coalesce(F.sum("n_ids").over(above), F.lit(0)))
    of_group = of_group.select(
        "file",
        "group",
        "g_base",
        F.coalesce(F.sum("n_ends").over(above), F.lit(0)).alias("g_first"),
        F.coalesce(F.max(F.col("g_base") + F.col("last")).over(above), F.lit(-1)).alias("g_carry"),
        F.when(F.lead("group").over(order).isNull(), F.col("top")).alias("top"),
    )
    own = inside.select("file", "group", "block", "base", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"), F.max("last").over(before).alias("carry"))
    stitched = own.join(of_group, ["file", "group"]).select(
        "file",
        "block",
        (F.col("g_base") + F.col("base")).alias("base"),
        (F.col("g_first") + F.col("first")).alias("first"),
        F.coalesce(F.col("g_base") + F.col("carry"), F.col("g_carry")).alias("carry"),
        F.coalesce(F.col("block") == F.col("top"), F.lit(False)).alias("is_last"),
    )
    whole = found.join(stitched, ["file", "block"])
    each = whole.select("file", "base", "first", "carry", "ends", F.posexplode("ends").alias("at", "place"))
    previous = F.when(F.col("at") > 0, F.col("base") + F.try_element_at("ends", F.greatest("at", F.lit(1)))).otherwise(F.col("carry"))
    done = each.select("file", (F.col("first") + F.col("at")).alias("ordinal"), (previous + 1).alias("start"), (F.col("base") + F.col("place") - previous - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    edge = F.coalesce(F.col("base") + F.try_element_at("ends", F.lit(-1)), F.col("carry"))
    rest = whole.where("is_last").select("file", (F.col("first") + F.size("ends")).alias("ordinal"), (edge + 1).alias("start"), (F.col("base") + F.col("n_ids") - edge - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Writes docs to flat token files, scans these, and names the documents again.

    One row for each row of docs: doc_id, n_tokens, file, ordinal, start. A null text has no token, a null
    doc_id stays null, repeated rows are documents of their own, extra columns are ignored, no row gives no result. A very
    long text is encoded in parts, and its ids, two bytes each, are one row of the writer and any number of blocks of the scan.
    """
    spark = docs.sparkSession
    files = write_token_files(docs, shared_dir(spark))
    if files is None:
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, ordinal long, start long")
    path, documents = files
    named = documents.select("file", "first", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    found = scan(token_blocks(spark, path, block)).withColumn("file", F.substring_index("file", "/", -1))
    return found.join(named, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")

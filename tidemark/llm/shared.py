"""What the operators share: the shared folder, written tables, hot-key lookups and text helpers."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these six.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
_BLANK = re.compile(f"[{BLANKS}]")
_TO_SPACE = str.maketrans(dict.fromkeys(BLANKS, " "))

#: A key counts as hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


_within: ContextVar[str | None] = ContextVar("within", default=None)


@contextmanager
def working_in(folder: str) -> Iterator[None]:
    """While this holds, new folders are made below folder, so that one removal clears them all."""
    before = _within.set(folder)
    try:
        yield
    finally:
        _within.reset(before)


@functools.cache
def _own() -> str:
    """A temporary folder of this process, for a local master only."""
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or where working_in() says. Where the setting is unset, a local master gets a temporary one."""
    top = _within.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _own()
    return f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: For rows of many kB: Parquet's pages and groups stay small, where it would look at a page's size every 100 rows only.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def written(df: DataFrame, path: str, how: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet and rereads it: cuts the lineage at files that outlive any executor."""
    df.write.mode("overwrite").options(**how or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system classes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def touched(spark: SparkSession, path: str) -> None:
    """Makes an empty file: what is written beside it is whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_kept: dict[object, object] = {}


def kept_by_worker(owner: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task, made at the first. A task with another owner lets it go, so a
    worker never holds the memory of two operators."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {n: spark.conf.get(n, None) for n in conf}
    for n, v in conf.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def cleaned_shuffles(spark: SparkSession):
    """While this holds, a query's shuffle files go at its end; its result has to be written by then."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers of a local master import this package wherever the driver was started, and hands them texts
    in batches of 1,000 rows where the session has Spark's default of 10,000, which is for narrow rows."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")


def spaced(text: str) -> str:
    """The six blanks, and only these, become spaces; nothing else does, unlike with str.split()."""
    if text.isascii() or not any(x in text for x in "\x09\x0b\x0c\x0d"):
        for x in BLANKS[1:]:
            if x in text:
                text = text.replace(x, " ")
        return text
    return text.translate(_TO_SPACE)


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about this many characters, cut only where a blank begins: bounds the memory that a very long text takes."""
    at = 0
    while len(text) - at > size:
        cut = _BLANK.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def words(text: str) -> list[str]:
    return [w for w in spaced(text).split(" ") if w]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(c: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


PLACE = "struct<file: string, row: long>"


def located(docs: DataFrame, folder: str) -> DataFrame:
    """docs as two columns: row, a struct of all columns, and place, the file a row is in with its number there.

    A place is the same in every scan, however the files are cut among tasks, so it finds the row again after executors
    were lost or added. Rows that aren't a Parquet table as it is read are written to folder first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):
            return _placed(docs)
    docs.write.mode("overwrite").parquet(folder)
    return _placed(docs.sparkSession.read.schema(docs.schema).parquet(folder))


def _placed(docs: DataFrame) -> DataFrame:
    at = docs.metadataColumn("_metadata")
    return docs.select(F.struct("*").alias("row"), F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias("place"))


#: Up to this many places are broadcast to drop rows; more are joined.
BROADCAST_PLACES = 200_000


def without(rows: DataFrame, dropped: DataFrame, folder: str) -> DataFrame:
    """The columns of the rows, as located() has them, whose place isn't in dropped."""
    dropped = written(dropped.select("place"), folder)
    small = dropped.count() <= BROADCAST_PLACES
    return rows.join(F.broadcast(dropped) if small else dropped, "place", "left_anti").select("row.*")


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows, left-joined with table on key; table has one row a key and, in count, the number of rows that have it.

    Keys with more than HOT_SHARE of total are at most 1 / HOT_SHARE, which bounds what is broadcast;
    each of the others fits a fraction of a task.
    """
    edge = max(1.0, total * HOT_SHARE)
    hot = table.where(F.col(count) > edge).withColumn("_hot", F.lit(True))
    names = [c for c in table.columns if c != key]
    cold = table.where(F.col(count) <= edge)
    marked = rows.join(F.broadcast(hot), key, "left")
    done = marked.where(F.col("_hot")).drop("_hot")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot", *names)
    return done.unionByName(rest.join(cold, key, "left"))

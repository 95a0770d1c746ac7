"""Small results that several plans read: written once to a folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    """A temporary folder of this process, for a local master only."""
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local master gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _own()
    return f"{top.rstrip('/')}/settled-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table that is written now and read from then on, whatever executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

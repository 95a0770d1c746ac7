"""Streaming front ends: windowed counts of events with late data, and a sweep that reruns as rows come in.

The batch engine needs neither; they feed and rerun it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


T = TypeVar("T")


def repeated(run: Callable[[int], T], every: timedelta, times: int | None = None, wait: Callable[[float], None] = time.sleep) -> Iterator[T]:
    """What run gives for 0, 1, 2 and so on, a stated number of times or for ever, with a wait between two runs and none after the last."""
    n = 0
    while times is None or n < times:
        if n:
            wait(every.total_seconds())
        yield run(n)
        n += 1


def windowed_counts(events: DataFrame, at: str = "ts", by: tuple[str, ...] = ("event_type",), window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """start, by, n, total of each tumbling or sliding window; rows later than the watermark are left out of a stream."""
    out = events.withColumn(at, F.col(at).cast("timestamp"))
    out = out.withWatermark(at, late) if out.isStreaming else out
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return out.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def stream_of(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream, by the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def on_arrival(stream: DataFrame, rerun: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls rerun(batch, version) for what has come in: once for all that is there, or every so often until stopped.

    A version may come twice after a failure, so rerun has to overwrite by version or upsert by key.
    """
    writer = stream.writeStream.foreachBatch(rerun).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

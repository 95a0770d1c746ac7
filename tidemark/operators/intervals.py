"""Joins of events and intervals with windows by equal bins of time, so that no plan compares every row with every window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days in a bin. A window of months is in a few bins, and an event in one.
WIDTH = 32
#: A key and bin with more than this share of all rows, and more than so many, is dealt out under salts.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 1000, 10_000, 16


def _bin(at: Column, width: int) -> Column:
    return F.floor(F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")) / width)


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """df in each bin that it touches; rows without an end, or with one before the start, are in none."""
    span = F.when(F.col(start) <= F.col(end), F.sequence(_bin(F.col(start), width), _bin(F.col(end), width)))
    return df.withColumn("_bin", F.explode(span))


def _salted(rows: DataFrame, windows: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with _salt: rows of a hot key are dealt out, its windows are repeated for each part.

    Hot keys are at most 1 / HOT_SHARE, which bounds what is broadcast.
    """
    each = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = each.crossJoin(F.broadcast(each.agg(F.sum("_n").alias("_all")))).where((F.col("_n") > HOT_ROWS) & (F.col("_n") > F.col("_all") * HOT_SHARE))  # one row
    hot = F.broadcast(hot.select(*on, F.lit(SALTS - 1).alias("_last")))
    last = F.coalesce("_last", F.lit(0))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), last + 1).cast("int")).drop("_last")
    return dealt, windows.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_last")


def _met(rows: DataFrame, windows: DataFrame, keys: list[str], skewed: bool) -> DataFrame:
    """rows and windows of one key and bin."""
    clash = (set(rows.columns) & set(windows.columns)) - {*keys, "_bin"}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    on = [*keys, "_bin"]
    if skewed:
        rows, windows = _salted(rows, windows, on)
        on.append("_salt")
    return rows.join(windows, on).drop("_salt")


def within(events: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end", closed: bool = False, skewed: bool = False, width: int = WIDTH) -> DataFrame:
    """Each event with each window of its keys that has it: start <= at, and at < end, or at <= end if closed.

    Both sides keep their columns, which have different names but for the keys. A null key, time or end meets nothing.
    Times may be dates or timestamps. Events of one key that may be a large part of all need skewed; counts by day don't.
    """
    time = lambda c: F.col(c).cast("timestamp_ntz")
    met = _met(events.withColumn("_bin", _bin(F.col(at), width)), _binned(windows, start, end, width), keys, skewed)
    return met.where((time(at) >= time(start)) & (time(at) <= time(end) if closed else time(at) < time(end))).drop("_bin")


def overlapping(intervals: DataFrame, windows: DataFrame, keys: list[str], begin: str, finish: str, start: str = "start", end: str = "end", skewed: bool = False, width: int = WIDTH) -> DataFrame:
    """Each interval with each window of its keys that it overlaps: begin < end and finish >= start. One that is still open drops out.

    A pair meets in every bin that both are in, and is taken from the first of these only, so nothing has to be made distinct.
    """
    time = lambda c: F.col(c).cast("timestamp_ntz")
    met = _met(_binned(intervals, begin, finish, width), _binned(windows, start, end, width), keys, skewed)
    first = F.col("_bin") == F.greatest(_bin(F.col(begin), width), _bin(F.col(start), width))
    return met.where(first & (time(begin) < time(end)) & (time(finish) >= time(start))).drop("_bin")


def spike_counts(days: DataFrame, windows: DataFrame, keys: list[str], day: str = "day", n: str = "n") -> DataFrame:
    """The windows (keys, baseline, start, end) that have events, with window_count in [start, end), baseline_count in [baseline, start), and their ratio.

    days: keys, day and the number n of events, so that a key has at most a row a day. The ratio over 0 is null.
    """
    now = F.col(day) >= F.col("start")
    met = within(days, windows, keys, day, "baseline", "end").groupBy(*windows.columns)
    out = met.agg(F.coalesce(F.sum(F.when(now, F.col(n))), F.lit(0)).alias("window_count"), F.coalesce(F.sum(F.when(~now, F.col(n))), F.lit(0)).alias("baseline_count"))
    return out.withColumn("ratio", F.try_divide(F.col("window_count").cast("double"), F.nullif(F.col("baseline_count").cast("double"), F.lit(0.0))))


def per_day(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, day, n: the number of events of a day, added up before anything is joined."""
    return events.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))

"""Temporal split into a training, a validation and a hold-out window."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_bounds(cutoff: str, start: str, end: str) -> tuple[date, date, date]:
    c, s, e = (date.fromisoformat(x) for x in (cutoff, start, end))
    if not c < s <= e:
        raise ValueError("need cutoff < window start <= window end")
    return c, s, e


def split_label(time: Column, cutoff: str, start: str, end: str) -> Column:
    """T1 up to the cutoff, T2 inside the window, T3 after it; a gap has no label."""
    c, s, e = check_bounds(cutoff, start, end)
    day = F.to_date(time)
    return (
        F.when(day <= F.lit(c), "T1").when(day.between(F.lit(s), F.lit(e)), "T2").when(day > F.lit(e), "T3")
    )


def temporal_split(df: DataFrame, cutoff: str, start: str, end: str, time: str = "timestamp") -> DataFrame:
    """Rows with a time that fall into a window, with their ``split``."""
    return (
        df.filter(F.col(time).isNotNull())
        .withColumn("split", split_label(F.col(time), cutoff, start, end))
        .filter(F.col("split").isNotNull())
    )


def window_rows(df: DataFrame, which: str, cutoff: str, start: str, end: str, time: str = "timestamp") -> DataFrame:
    """One window as a plain range predicate on time, which reaches the scan."""
    c, s, e = check_bounds(cutoff, start, end)
    t = F.col(time)
    after = lambda d: F.lit(d).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    if which == "T1":
        return df.filter(t < after(c))
    if which == "T2":
        return df.filter((t >= F.lit(s).cast("timestamp_ntz")) & (t < after(e)))
    if which == "T3":
        return df.filter(t >= after(e))
    raise ValueError(f"unknown window {which!r}")


def split_summary(split: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows and time range per split."""
    return split.groupBy("split").agg(
        F.count("*").alias("rows"), F.min(time).alias("min_time"), F.max(time).alias("max_time")
    )


def time_range(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))

"""Append-only counts over streams of (ts, value): the frequencies that a sequence index gives, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str = "ts", value: str = "value", window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, value, frequency) for each window of time; a window is given out once the watermark has passed it, later rows are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs one with a zone
    counted = timed.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), value).agg(F.count(F.lit(1)).alias("frequency"))
    return counted.select(F.col("w.start").alias("start"), value, "frequency")


def running_counts(stream: DataFrame, value: str = "value") -> DataFrame:
    """(value, frequency) so far; for the update or complete mode."""
    return stream.groupBy(value).agg(F.count(F.lit(1)).alias("frequency"))

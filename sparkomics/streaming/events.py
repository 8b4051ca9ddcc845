"""Windowed counts over a stream: an extension; the batch operators' semantics carry over within a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_freq(stream: DataFrame, time: str, key: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, key, n: rows by key in windows of time; rows later than `late` behind the newest are dropped."""
    spans = F.window(time, window, slide) if slide else F.window(time, window)
    counted = stream.withWatermark(time, late).groupBy(spans.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")

"""Windowed aggregates over event streams; the same plan runs on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream gets a watermark, which asks for a time with zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, keys, n, total) for tumbling windows; on streams, rows later than `late` are left out."""
    source = _marked(events, ts, late)
    out = source.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): runs of events with no gap as long as this."""
    source = _marked(events, ts, late)
    out = source.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")

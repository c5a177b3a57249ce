"""Event-time windows and deduplication; the same code serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """ts as TIMESTAMP (a TIMESTAMP_NTZ has no watermark), with a watermark if the frame streams."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if out.isStreaming else out


def tumbling(events: DataFrame, size: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return _counted(events, F.window(ts, size), by, value)


def sliding(events: DataFrame, size: str, step: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return _counted(events, F.window(ts, size, step), by, value)


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return _counted(events, F.session_window(ts, gap), by, value)


def _counted(events: DataFrame, window: Column, by: list[str], value: str) -> DataFrame:
    return events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each key; on a stream, within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)

"""Event counts in time windows. The reference has no streaming: this is an addition for the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or table of events (ts, event_type, value); late rows are dropped in streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone's timestamp
    stream = timed.withWatermark("ts", lateness) if events.isStreaming else timed
    g = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")

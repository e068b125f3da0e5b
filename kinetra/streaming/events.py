"""Episode frames as a stream: event-time windows with a bound on lateness. The online side of the same features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and spread of value by event type and window, for a stream or a table of events (ts, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", window).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "std")

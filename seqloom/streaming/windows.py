"""Extension: windowed counts over an event stream (the batch operators have no streaming counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, *, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and event type: events and summed value. On a stream, rows later than ``late`` are dropped; batch input counts all."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")

"""Extension: the interaction aggregates as streams, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per node and day from a streaming or static DataFrame (node_id, at)."""
    e = events.withWatermark("at", late) if events.isStreaming else events
    return e.groupBy(F.window("at", "1 day"), "node_id").agg(F.count("*").alias("n"), F.max("at").alias("latest"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("at", late) if events.isStreaming else events
    return e.groupBy(F.session_window("at", gap), "node_id").agg(F.count("*").alias("n"))

"""Event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ingest import GAP_S


def counted(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type and window; works on batches and on streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("w.start", "event_type", "events", "total")


def session_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{GAP_S} seconds").alias("w")).agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")

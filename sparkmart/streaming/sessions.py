"""Windows over an event stream with a watermark; on a batch the same functions give the same rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """One row per user and run of events that a gap ends; state of a session goes when the watermark passes its end."""
    timed = events.withColumn("__at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    rows = timed.groupBy(F.col(user), F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("event_count"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("bought"))
    return rows.select(user, F.col("w.start").alias("first_event_at"), F.col("w.end").alias("ends_at"), "event_count", (F.col("bought") == 1).alias("has_purchase"))


def daily_counts(events: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events per UTC day and type."""
    timed = events.withColumn("__at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    return timed.groupBy(F.window("__at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")

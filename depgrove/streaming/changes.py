"""Dependency changes as a stream: beyond what the batch operators do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_counts(changes: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """changes: event_id, ts, event_type. Counts per window and type; an event that comes twice counts once, one that comes later than
    `late` not at all."""
    once = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(changes: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no pause of `gap`."""
    found = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")

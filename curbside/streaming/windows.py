"""Windowed counts, sessions and de-duplication over streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a zone; stored times without one are taken as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """Count and sum by window and type; a window closes when ``late`` has passed."""
    rows = timed(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.col("total").cast("decimal(28,2)").alias("total"))


def sliding(events: DataFrame, minutes: int = 30, step: int = 10, late: str = "30 minutes") -> DataFrame:
    rows = timed(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", f"{minutes} minutes", f"{step} minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Bursts of one user: rows less than ``gap`` apart."""
    rows = timed(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; on streams a key is remembered for ``late``."""
    rows = timed(events)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)

"""Streaming forms of the history operators: an extension beyond the batch reports, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, time: str = "ts", key: str = "module", late: str = "7 days", width: str = "7 days") -> DataFrame:
    """(key, week_start, commits) per tumbling window; events later than the watermark are left out."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("commits")).select(key, F.col("w.start").alias("week_start"), "commits")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, events) per session."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def touch_counts(touches: DataFrame) -> DataFrame:
    """Running commits per path, for update mode: state is one row per path."""
    return touches.groupBy("path").agg(F.count("*").alias("commits"))

"""Counters over a live audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.functions.scalars import filled


def stream_audit_counts(records: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests per time window, method, path and status of audit records (ts_ms, http).

    Works on a stream (append mode) and on a batch.
    """
    at = F.timestamp_millis("ts_ms").alias("ts")
    flat = records.select(
        at,
        F.upper(F.coalesce(filled("http.method"), F.lit("UNKNOWN"))).alias("method"),
        F.coalesce(filled("http.path"), F.lit("/")).alias("path"),
        F.coalesce(F.col("http.status").cast("string"), F.lit("unknown")).alias("status"),
    )
    counted = (
        flat.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "method", "path", "status")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counted.select(F.col("window.start").alias("window_start"), "method", "path", "status", "requests")

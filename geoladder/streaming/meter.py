"""Byte meter of fetches: what a view and a whole session have read, by phase; in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fetch_log(events: DataFrame) -> DataFrame:
    """A log of fetches in the shape of the meter: phase, bytes, cached, view, t, id."""
    return events.select(F.col("event_type").alias("phase"), F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"), (F.col("event_id") % 3 == 0).alias("cached"), F.col("user_id").alias("view"), F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("id"))


def byte_meter(log: DataFrame) -> DataFrame:
    """view, phase, bytes, requests, hits: per view and phase, per phase, and in all, in one pass."""
    log.createOrReplaceTempView("__fetch_log")
    return log.sparkSession.sql(
        "SELECT view, phase, sum(CASE WHEN cached THEN 0 ELSE bytes END) AS bytes, count_if(NOT cached) AS requests, count_if(cached) AS hits, grouping_id() AS scope "
        "FROM __fetch_log GROUP BY GROUPING SETS ((view, phase), (phase), ())"
    )


def recent(log: DataFrame, n: int = 300) -> DataFrame:
    """The last n fetches, newest first: a bounded sort that keeps n rows per task."""
    return log.orderBy(F.col("t").desc(), F.col("id").desc()).limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.col("t").desc(), F.col("id").desc())))


def stream_meter(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The meter over a stream: bytes and requests per window and phase, late data within the watermark counted."""
    return log.withWatermark("t", late).groupBy(F.window("t", window).alias("w"), "phase").agg(F.sum(F.when(F.col("cached"), 0).otherwise(F.col("bytes"))).alias("bytes"), F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "phase", "bytes", "requests")

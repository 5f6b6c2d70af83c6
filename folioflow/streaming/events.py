"""Streams of job events: status folded with state, windows, duplicates.

The windows are this engine's own addition; the fold gives what the batch fold gives at the end of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import fold_status

def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fold_status_stream(events: DataFrame) -> DataFrame:
    """The batch fold over a stream, in update mode: one running maximum a job, whatever the order of the events."""
    return fold_status(events.select("workflow_id", "ref", "event_id", "event_type", "message"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts_by_window(events: DataFrame, *, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = _timed(events, late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_events(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])

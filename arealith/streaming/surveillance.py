"""Windowed counts over a stream of events: our own extension, the batch twin is ``surveillance_windows``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as they arrive in Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; state of windows older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("at"), "event_type", "n", "total")

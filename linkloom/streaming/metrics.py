"""Streaming counts of search events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total per window. On a stream, windows close once the watermark has passed them; the state
    holds open windows only. On a table it is a plain aggregation."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant, not a local time
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    counts = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select("event_type", F.col("window.start").alias("start"), "n", "total")


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream over Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

"""Structured Streaming views of population events (an extension: the reference has no streams).

Events arrive with a time; counts per kind and window close when the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window_start, kind, n, total`` per closed window; works on a stream and on a table alike."""
    at = events.withColumn("__at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("__at", late)
    grouped = at.groupBy(F.window("__at", window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "kind", "n", "total")

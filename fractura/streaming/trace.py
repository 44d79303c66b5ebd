"""The candidate trace as a stream: tumbling-window statistics with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and operator: count, best and mean objective. Works on a batch or a stream with a ``ts`` timestamp."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("operator")).agg(F.count("*").alias("n"), F.min("value").alias("best"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "operator", "n", "best", "mean")

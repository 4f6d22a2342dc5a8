"""Windowed counts over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """The same plan for a batch and a stream."""
    e = events
    if events.isStreaming:  # a watermark needs a time with a zone
        e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = e.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")

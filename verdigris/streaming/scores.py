"""Score events as a stream: windowed means with late data, beside the append-only history of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) for each window; events later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_windowed(events: DataFrame, name: str, checkpoint: str, window: str = "1 hour", late: str = "2 hours"):
    """Starts the query into a table in memory; for a store use ``writeStream`` on ``windowed_scores``."""
    return windowed_scores(events, window, late).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Windows over a stream of cache events. An extension: the operators it joins have no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes", at: str = "ts") -> DataFrame:
    """Events and mean value by window and type; ``late`` is the watermark of a stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark(at, late)
    out = rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes", at: str = "ts") -> DataFrame:
    """Events of a user without a pause longer than the gap."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming and late:
        rows = rows.withWatermark(at, late)
    out = rows.groupBy(F.session_window(at, gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")

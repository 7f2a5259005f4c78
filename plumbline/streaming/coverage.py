"""An extension: running coverage of predicted intervals over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_coverage(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """For each event type and time window: events and the share within [lower, upper]; works on
    streams (with a watermark) and on tables alike.  Null values are not covered."""
    inside = F.coalesce((F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper")), F.lit(False))
    # Watermarks ask for a time with a zone.
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "coverage")


def with_bounds(events: DataFrame, lower: float, upper: float) -> DataFrame:
    return events.withColumns({"lower": F.lit(lower), "upper": F.lit(upper)})

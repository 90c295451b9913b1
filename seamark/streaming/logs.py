"""Streams of query logs and events. An extension: late rows are bounded by a watermark, state by the windows still open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attributed(log: DataFrame, emitters: DataFrame) -> DataFrame:
    """log(ts, action, ...) with the unit whose action it is: a stream joined to a static table, which needs no state."""
    unit = emitters.groupBy(F.col("action").alias("a")).agg(F.min("unit").alias("unit"))
    return log.join(unit, F.col("action") == F.col("a"), "left").drop("a")


def counts(events: DataFrame, by: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by, n, total) for tumbling, or with slide for sliding, windows of events(ts, value, by)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, stop, n): bursts of events(ts, by) with less than the gap between one and the next."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once_each(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key among those within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

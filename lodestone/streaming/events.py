"""Event streams: windowed counts with late rows, and the first row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sums of each window and kind; rows over ``late`` behind are dropped by the watermark."""
    w = F.window(at, size)
    counted = events.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n_rows", "total")


def first_of_key(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """First-writer-wins: the first row that comes with a key, as long as the watermark remembers it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

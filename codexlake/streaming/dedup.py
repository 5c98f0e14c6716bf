"""Streams: content dedup within a watermark and windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: Column, at: str, late: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen before within the watermark; state is bounded by it."""
    return stream.withColumn("_key", key).withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, at: str, group: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, length), group).agg(F.count(F.lit(1)).alias("n"))

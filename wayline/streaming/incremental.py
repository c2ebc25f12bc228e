"""Counts kept up to date over appended rows: the batch operators' plans on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators import spatial


def zone_counts(points: DataFrame, zones: DataFrame, *by: str) -> DataFrame:
    """Running count of streamed points by zone and by; the state is a row for each group. For update or complete mode."""
    return spatial.locate(points, zones).filter("zone is not null").groupBy("zone", *by).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(rows: DataFrame, at: str, width: str, late: str, *by: Column | str) -> DataFrame:
    """Count by time window and by; windows close once the watermark is past them. For append mode."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))

"""Votes over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.votes import parsed, weight
from ..options import Options


def windowed_votes(readings: DataFrame, o: Options, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """group_id, window, text, weight of readings with captured_at; a window closes when the watermark passes it."""
    rows = parsed(readings.withWatermark("captured_at", late)).where("plate_text is not null")
    return rows.groupBy(F.window("captured_at", window), "group_id", F.col("plate_text").alias("text")).agg(F.sum(weight(o)).alias("weight"))

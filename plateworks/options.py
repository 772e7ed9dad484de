"""Thresholds of the plate queries; each may be set as ``spark.plateworks.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    confidence: float = 0.25
    duplicate_iou: float = 0.6
    crop_padding: float = 0.08
    weight_floor: float = 0.01
    ocr_upscale: float = 4.0

    @classmethod
    def of(cls, spark: SparkSession) -> Options:
        """Options of a session; a value that is no number counts as not set."""
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = float(spark.conf.get(f"spark.plateworks.{f.name}", ""))
            except ValueError:
                pass
        return cls(**found)

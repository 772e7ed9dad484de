"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs of integer corners; 0 without overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0))
    area = lambda x: (x["x2"] - x["x1"]).cast("long") * (x["y2"] - x["y1"])
    union = area(a) + area(b) - inter
    return F.coalesce(inter.cast("double") / F.nullif(union, F.lit(0)), F.lit(0.0))


def slice_end(end: Column, width: Column) -> Column:
    """End of a slice of [0, width): clipped, and counted from the far side if negative."""
    return F.when(end < 0, F.greatest(width + end, F.lit(0))).otherwise(F.least(end, width))

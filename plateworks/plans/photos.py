"""From photo files to plates: detector, crops and recogniser over the bytes of the photos.

A photo's bytes are read once, go to Python once, in batches bounded in bytes, and
are never shuffled: the pass that detects boxes also cuts their crops. What
follows joins boxes, crops and tasks only. The hooks are a user's own:

- detector: frame of path, content, img_w, img_h -> for each photo a list of (x1, y1, x2, y2, confidence)
- cropper: (content, boxes in whole pixels) -> a crop's bytes for each box
- segmenter: frame of crop, plate_w, plate_h -> for each crop a list of (x, y, w, h, area) of its connected components
- recogniser: frame of crop, field, variant_no, rendering, alphabet -> for each task a list of (text, confidence)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boxes as b
from ..operators import stages
from ..operators import votes as v
from ..options import Options
from ..sources.images import size_of
from ..sources.saved import saved
from . import reading as r
from .staged import Recogniser, Staged, staged

KEY = v.DETECTION
_SEEN = "n int, img_w int, img_h int, x1 double, y1 double, x2 double, y2 double, confidence double, crop binary"


def grown(box: tuple[float, ...], w: int, h: int, o: Options) -> tuple[int, int, int, int] | None:
    """A box as :func:`~plateworks.operators.boxes.padded` makes it; None where that drops it."""
    x1, y1, x2, y2 = box
    dx, dy = (x2 - x1) * o.crop_padding, (y2 - y1) * o.crop_padding
    out = max(0, int(x1 - dx)), max(0, int(y1 - dy)), min(w, int(x2 + dx)), min(h, int(y2 + dy))
    return out if out[2] > out[0] and out[3] > out[1] else None


def seen(files: DataFrame, detector: Callable[[], Callable], cropper: Callable | None, o: Options) -> DataFrame:
    """path, n, img_w, img_h, box, confidence, crop, error: a row numbered 1 for each photo, and one for each box after it.

    A photo that is no image, or that the detector fails on, has one row with its error.
    """

    def make() -> Callable:
        detect = detector()

        def look(frame: pd.DataFrame) -> list[list[tuple] | str]:
            sizes = [size_of(c) for c in frame["content"]]
            known = [k for k, s in enumerate(sizes) if s]
            sized = frame.iloc[known].assign(img_w=[sizes[k][0] for k in known], img_h=[sizes[k][1] for k in known])
            out: list[list[tuple] | str] = ["ValueError: no image of a known kind"] * len(frame)
            for k, found in zip(known, stages.answers(detect, sized), strict=True):
                out[k] = found if isinstance(found, str) else [(*sizes[k], *[None] * 6), *crops(frame["content"].iloc[k], sizes[k], found)]
            return out

        def crops(content: bytes, size: tuple[int, int], found: list[tuple]) -> list[tuple]:
            wanted = [grown(f[:4], *size, o) if cropper and f[4] > o.confidence else None for f in found]
            boxes = [w for w in wanted if w]
            cut = iter(cropper(content, boxes) if boxes else ())
            return [(*size, *map(float, f[:5]), next(cut) if w else None) for f, w in zip(found, wanted, strict=True)]

        return look

    return stages.run(files.select("path", "content"), make, _SEEN, unseen=("content",))


@dataclass(frozen=True)
class Photos:
    """Photos of vehicles, their detections, what could not be read, and the votes."""

    photos: DataFrame
    found: DataFrame
    crops: DataFrame
    failed: DataFrame
    staged: Staged


def over_crops(crops: DataFrame, recogniser: Callable[[], Callable]) -> Recogniser:
    """A recogniser of tasks over crops; a crop goes to Python once, with all its tasks of a phase (29 at most)."""

    def read(tasks: DataFrame) -> DataFrame:
        each = F.struct("field", "variant_no", "rendering", "alphabet")
        lists = tasks.groupBy(*KEY).agg(F.collect_list(each).alias("tasks"))
        return stages.run(crops.join(lists, [*KEY]), recogniser, stages.READING, unseen=("crop",), each="tasks")

    return read


def read_photos(files: DataFrame, detector: Callable[[], Callable], recogniser: Callable[[], Callable], o: Options, cropper: Callable | None = None, segmenter: Callable[[], Callable] | None = None) -> Photos:
    """Plates in photo files (path, content): each folder is a vehicle, its files in order of their names are its photos.

    Without a segmenter no plate is cut into fields, and all are read whole.
    Photos with an error have no detections; they count as photos of their vehicle.
    """
    table = saved(seen(files, detector, cropper, o), "seen")
    folder = F.regexp_extract("path", "^(.*?)/?[^/]*$", 1)
    order = F.row_number().over(Window.partitionBy("group_id").orderBy("path"))
    photos = table.where("n <= 1").select(F.col("path").alias("photo_id"), folder.alias("group_id"), "path", "img_w", "img_h", "error")
    photos = saved(photos.withColumn("position", order), "photos")
    boxes = table.where("n > 1").select(F.col("path").alias("photo_id"), (F.col("n") - 1).alias("det_seq"), *b.BOX, "confidence")
    found = saved(r.detections(boxes, photos, o), "found")
    cut = table.where("n > 1").select(F.col("path").alias("photo_id"), (F.col("n") - 1).alias("det_seq"), "crop")
    size = [(F.col(f"{c}2") - F.col(f"{c}1")).alias(n) for c, n in (("x", "plate_w"), ("y", "plate_h"))]
    crops = saved(cut.join(found.select(*KEY, "det_index", *size), [*KEY]), "crops")
    cuts = _cuts(crops, segmenter)
    done = staged(found, cuts, over_crops(crops.select(*KEY, "crop"), recogniser), o)
    return Photos(photos.drop("error"), found, crops, photos.where("error is not null").select("path", "error"), done)


def _cuts(crops: DataFrame, segmenter: Callable[[], Callable] | None) -> DataFrame:
    shape = crops.select(*KEY, "plate_w", "plate_h", "crop")
    if segmenter is None:
        statistics = shape.drop("crop").limit(0).selectExpr("*", *(f"0 AS {c}" for c in ("comp_id", "x", "y", "w", "h", "area")))
    else:
        statistics = stages.run(shape, segmenter, "comp_id int, x int, y int, w int, h int, area int", unseen=("crop",)).where("error is null")
    return b.field_cuts(statistics, KEY)

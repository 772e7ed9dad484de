"""Overlap and greedy suppression of boxes without lists of a photo, for photos of any number of boxes.

Two boxes whose overlap reaches the limit t have sides within a factor of 1 / t of
each other, and their corners lie within (1 - t) of the longer side. Sides are put
into levels, a grid belongs to each pair of levels, and its cells are that wide:
such boxes lie in the same cell or in neighbouring ones of the grid of the lesser
levels. Every box is at home in one cell of each of four grids.

Suppression goes in rounds. A box that is the surest of all undecided ones in the
cells around it is kept, and the undecided boxes that overlap it too much go. The
boxes that one round keeps are far from each other, so a round makes rows in
proportion to the undecided boxes, even where all boxes are the same. Which boxes
remain can hang on a chain of all of them, one after the other, so what is still
undecided after ROUNDS is settled in one pass over each photo's rest.
"""

from __future__ import annotations

from itertools import product
from math import floor, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import iou
from ..options import Options
from ..sources.saved import large, saved
from .boxes import BOX, deduplicated
from .boxes import overlap_pairs as listed_pairs

#: Boxes of a photo that are settled as a list, and rounds before the rest is settled in order.
LIST, ROUNDS = 256, 8
#: Keeps rounding from setting boxes apart that lie just within reach.
SLACK = 1.001
CELL = ("photo_id", "gw", "gh", "cx", "cy")
ORDER = ("rank", "det_seq")


def _base(t: float) -> float:
    if not 0 < t <= 1:
        raise ValueError("the limit of overlap must lie above 0, up to 1")
    return SLACK / t


_AROUND = tuple(product((-1, 0, 1), repeat=2))


def _cells(boxes: DataFrame, t: float, near: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Boxes with their own cell in each of four grids, or with those that lie so far from it."""
    base = _base(t)
    level = lambda low, high: F.floor(F.ln((F.col(high) - F.col(low)).cast("double")) / log(base)).cast("int")
    leveled = boxes.withColumns({"lw": level("x1", "x2"), "lh": level("y1", "y2")})
    side = lambda c, g: F.floor(F.col(c) / ((1 - t + SLACK - 1) * F.pow(F.lit(base), F.col(g) + 2)))
    grids = F.explode(F.array(*(F.struct((F.col("lw") - i).alias("gw"), (F.col("lh") - j).alias("gh")) for i, j in product((0, 1), repeat=2))))
    at = leveled.select("*", grids.alias("g")).select("*", "g.*").drop("g").withColumns({"cx": side("x1", "gw"), "cy": side("y1", "gh")})
    if not near:
        return at
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near)))
    return at.select("*", around.alias("a")).withColumns({"cx": F.col("cx") + F.col("a.i"), "cy": F.col("cy") + F.col("a.j"), "away": (F.col("a.i") != 0) | (F.col("a.j") != 0)}).drop("a")


def _meeting(left: DataFrame, right: DataFrame, o: Options, near: tuple[tuple[int, int], ...] = _AROUND) -> DataFrame:
    """a and b of each pair, once, of boxes that overlap too much, b's cell lying that far from a's."""
    box = lambda p, *more: F.struct("det_seq", "lw", "lh", *BOX, *more).alias(p)
    # Dealt by cell, however the photos are: one may have most boxes.
    a = _cells(left, o.duplicate_iou, near).select(*CELL, box("a", "away")).repartition(*CELL)
    b = _cells(right, o.duplicate_iou).select(*CELL, box("b")).repartition(*CELL)
    own = (F.least("a.lw", "b.lw") == F.col("gw")) & (F.least("a.lh", "b.lh") == F.col("gh"))
    return a.join(large(b), [*CELL]).where(own & (F.col("a.det_seq") != F.col("b.det_seq"))).withColumn("iou", iou(F.col("a"), F.col("b"))).where(F.col("iou") >= o.duplicate_iou)


def overlap_pairs(boxes: DataFrame, o: Options, limit: int = 0) -> DataFrame:
    """The pairs of :func:`~plateworks.operators.boxes.overlap_pairs`; of photos with more boxes than the limit, only those near each other are compared.

    A pair is met from one side alone: half of the cells around a box are looked into.
    """
    counted = boxes.withColumn("_n", F.count("*").over(Window.partitionBy("photo_id")))
    many = (counted.where(F.col("_n") > limit) if limit else boxes).select(*boxes.columns)
    met = _meeting(many, many, o, tuple(at for at in _AROUND if at >= (0, 0)))
    met = met.where((F.col("a.det_seq") < F.col("b.det_seq")) | F.col("a.away"))
    first, second = F.least("a.det_seq", "b.det_seq"), F.greatest("a.det_seq", "b.det_seq")
    pairs = met.select("photo_id", first.alias("a_seq"), second.alias("b_seq"), F.round("iou", 6).alias("iou"))
    return listed_pairs(counted.where(F.col("_n") <= limit), o).unionByName(pairs) if limit else pairs


def _rank() -> Column:
    return (-F.col("confidence")).alias("rank")


def _surest(left: DataFrame, o: Options) -> DataFrame:
    """The boxes that a round keeps, saved."""
    order = F.struct(*ORDER)
    home = _cells(left, o.duplicate_iou)
    tops = home.groupBy(*CELL).agg(F.min(order).alias("top"))
    firsts = tops.groupBy("photo_id", "top").agg(F.count("*").alias("n")).where("n = 4").select("photo_id", "top.*")
    # Only the surest of its own cells looks around.
    sure = saved(left.join(large(firsts.select("photo_id", "det_seq")), ["photo_id", "det_seq"], "left_semi"), "sure")
    asking = _cells(sure, o.duplicate_iou, _AROUND)
    beaten = asking.join(large(tops), [*CELL]).where(F.col("top") < order).select("photo_id", "det_seq").distinct()
    return saved(sure.join(large(beaten), ["photo_id", "det_seq"], "left_anti"), "kept")


def _decided(kept: DataFrame, left: DataFrame, o: Options) -> DataFrame:
    """photo_id, det_seq, kept of the boxes that are kept and of those that go with them."""
    gone = _meeting(kept, left, o).select("photo_id", F.col("b.det_seq").alias("det_seq")).distinct()
    return kept.select("photo_id", "det_seq", F.lit(True).alias("kept")).unionByName(gone.withColumn("kept", F.lit(False)))


def _round(left: DataFrame, o: Options) -> DataFrame:
    """photo_id, det_seq, kept of boxes that a round decides."""
    return _decided(_surest(left, o), left, o)


def _in_order(left: DataFrame, o: Options) -> DataFrame:
    """What is kept of each photo's rest, by one pass in order of confidence over cells of kept boxes."""
    t, base = o.duplicate_iou, _base(o.duplicate_iou)
    columns = left.columns

    def area(b: tuple) -> int:
        return (b[2] - b[0]) * (b[3] - b[1])

    def overlap(a: tuple, b: tuple) -> float:
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / (area(a) + area(b) - inter)

    def photo(rows: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list[tuple]] = {}
        kept = []
        ordered = rows.sort_values([*ORDER])
        for k, b in enumerate(zip(*(ordered[c].tolist() for c in BOX), strict=True)):
            lw, lh = floor(log(b[2] - b[0]) / log(base)), floor(log(b[3] - b[1]) / log(base))
            homes = []
            for gw, gh in product((lw, lw - 1), (lh, lh - 1)):
                sx, sy = ((1 - t + SLACK - 1) * base ** (g + 2) for g in (gw, gh))
                homes.append((gw, gh, floor(b[0] / sx), floor(b[1] / sy)))
            near = (other for gw, gh, x, y in homes for i, j in product((-1, 0, 1), repeat=2) for other in cells.get((gw, gh, x + i, y + j), ()))
            if all(overlap(other, b) < t for other in near):
                kept.append(k)
                for home in homes:
                    cells.setdefault(home, []).append(b)
        return ordered.iloc[kept][columns]

    return left.groupBy("photo_id").applyInPandas(photo, left.schema)


def in_rounds(boxes: DataFrame, o: Options, rounds: int = ROUNDS) -> DataFrame:
    """The rows of :func:`~plateworks.operators.boxes.deduplicated`, whatever the number of a photo's boxes."""
    key = ["photo_id", "det_seq"]
    left, out = saved(boxes.withColumn("rank", _rank()), "undecided"), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        kept = _surest(left, o)
        out.append(kept)
        left = saved(left.join(large(_decided(kept, left, o)), key, "left_anti"), "undecided")
    out.append(_in_order(left, o))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(*boxes.columns)


def suppressed(boxes: DataFrame, o: Options, limit: int = LIST) -> DataFrame:
    """Boxes in order of confidence, each kept if it overlaps no kept one too much; crowded photos in rounds, others as lists."""
    crowded = saved(boxes.groupBy("photo_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("photo_id"), "crowded")
    if crowded.isEmpty():
        return deduplicated(boxes, o)
    few = deduplicated(boxes.join(large(crowded), "photo_id", "left_anti"), o)
    return few.unionByName(in_rounds(boxes.join(large(crowded), "photo_id", "left_semi"), o).select(*few.columns))

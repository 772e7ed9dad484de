"""Detector boxes: threshold, padding, overlap, greedy suppression, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import iou, slice_end
from ..options import Options
from ..sources.saved import large

BOX = ("x1", "y1", "x2", "y2")


def confident(boxes: DataFrame, o: Options) -> DataFrame:
    return boxes.where(F.col("confidence") > o.confidence)


def padded(boxes: DataFrame, photos: DataFrame, o: Options) -> DataFrame:
    """Boxes grown on each side, cut to whole pixels inside the photo; empty ones go."""
    pad = F.lit(o.crop_padding)
    size = photos.select("photo_id", "img_w", "img_h")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    low = lambda c, s: F.greatest(F.lit(0), (F.col(c) - s * pad).cast("int")).alias(c)
    high = lambda c, s, top: F.least(F.col(top), (F.col(c) + s * pad).cast("int")).alias(c)
    out = boxes.join(large(size), "photo_id").select("photo_id", "det_seq", low("x1", w), low("y1", h), high("x2", w, "img_w"), high("y2", h, "img_h"), "confidence")
    return out.where("x2 > x1 and y2 > y1")


def overlap_pairs(boxes: DataFrame, o: Options) -> DataFrame:
    """Pairs of a photo's boxes that overlap too much; boxes of a photo are few."""
    a, b = (boxes.select("photo_id", F.col("det_seq").alias(f"{p}_seq"), F.struct(*BOX).alias(p)) for p in "ab")
    both = a.join(large(b), "photo_id").where("a_seq < b_seq").withColumn("iou", iou(F.col("a"), F.col("b")))
    return both.where(F.col("iou") >= o.duplicate_iou).select("photo_id", "a_seq", "b_seq", F.round("iou", 6).alias("iou"))


def deduplicated(boxes: DataFrame, o: Options) -> DataFrame:
    """Boxes in order of confidence, each kept if it overlaps no kept one too much."""
    item = F.struct((-F.col("confidence")).alias("rank"), "det_seq", *BOX, "confidence")
    lists = boxes.groupBy("photo_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    none = F.filter("l", lambda b: F.lit(False))
    keep = F.aggregate("l", none, lambda kept, b: F.when(F.forall(kept, lambda k: iou(k, b) < o.duplicate_iou), F.array_append(kept, b)).otherwise(kept))
    return lists.select("photo_id", F.inline(keep)).drop("rank")


def indexed(boxes: DataFrame) -> DataFrame:
    """det_index from 1 in each photo, by confidence."""
    w = Window.partitionBy("photo_id").orderBy(F.desc("confidence"), "det_seq")
    return boxes.withColumn("det_index", F.row_number().over(w))


# Shares of the plate's size that tell bars, glyphs and bodies apart.
BAR_LOW, GLYPH_HIGH, GLYPH_WIDE, BAR_ASPECT, CUT_MARGIN = 0.30, 0.95, 0.30, 0.22, 0.03
OCR_HEIGHT, OCR_MARGIN, WORKING_SCALE = 160, 40, 6


def separator_bars(components: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    tall = (d("h") >= d("plate_h") * BAR_LOW) & (d("h") <= d("plate_h") * GLYPH_HIGH)
    narrow = (d("w") <= d("plate_w") * GLYPH_WIDE) & (F.col("w") >= 2) & (F.col("area") >= 20)
    return components.where(tall & narrow & (d("w") / d("h") < BAR_ASPECT))


def field_cuts(components: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """[start, end) of each field between a crop's outermost bars, and whether all three are there."""
    # Place and width as one number, so that ends are found in hash tables; a bar is at least 2 wide.
    bar = F.shiftleft(F.col("x").cast("long"), 32) + F.col("w")
    ends = separator_bars(components).groupBy(*keys).agg(F.min(bar).alias("a"), F.max(bar).alias("b"), F.count("*").alias("n_bars"))
    end = lambda e: F.struct(F.shiftright(e, 32).cast("int").alias("x"), F.col(e).bitwiseAND((1 << 32) - 1).cast("int").alias("w")).alias(e)
    ends = ends.select(*keys, end("a"), end("b"), "n_bars")
    crops = components.select(*keys, "plate_w", "plate_h").distinct().join(large(ends), [*keys], "left")
    half = lambda e: F.col(f"{e}.x") + F.floor(F.col(f"{e}.w") / 2).cast("int")
    c = crops.withColumns({"n_bars": F.coalesce("n_bars", F.lit(0)).cast("int"), "left_cut": half("a"), "right_cut": half("b")})
    least = F.col("plate_w") * F.lit(CUT_MARGIN)
    sound = (F.col("n_bars") >= 2) & (F.col("left_cut") >= least) & (F.col("right_cut") <= F.col("plate_w") - least) & (F.col("right_cut") - F.col("left_cut") >= least)
    bounds = {
        "digits_start": F.lit(0),
        "digits_end": F.greatest(F.lit(0), F.col("left_cut") - F.col("a.w")),
        "letter_start": F.least(F.col("left_cut") + F.col("a.w"), F.col("plate_w")),
        "letter_end": slice_end(F.col("right_cut") - F.col("b.w"), F.col("plate_w")),
        "region_start": F.least(F.col("right_cut") + F.col("b.w"), F.col("plate_w")),
        "region_end": F.col("plate_w"),
    }
    c = c.withColumns({k: F.when(sound, v) for k, v in bounds.items()})
    whole = F.lit(True)
    for f in ("digits", "letter", "region"):
        whole = whole & F.coalesce(F.col(f"{f}_end") > F.col(f"{f}_start"), F.lit(False))
    return c.select(*keys, "plate_w", "plate_h", "n_bars", *bounds, whole.alias("is_complete"))


def ink_extent(components: DataFrame) -> DataFrame:
    """Rows [y0, y1) of a crop's glyphs with a margin; all rows if it has none."""
    rim = (F.col("w") > F.col("plate_w") * F.lit(0.85)) & (F.col("h") < F.col("plate_h") * F.lit(0.40))
    glyph = (F.col("area") >= 8) & (F.col("y") > 1) & (F.col("y") + F.col("h") < F.col("plate_h") - 1) & ~rim
    each = components.groupBy("crop_id", "plate_h").agg(F.min(F.when(glyph, F.col("y"))).alias("top"), F.max(F.when(glyph, F.col("y") + F.col("h"))).alias("low"))
    pad = F.greatest(F.lit(2), ((F.col("low") - F.col("top")) * F.lit(0.12)).cast("int"))
    y = each.select("crop_id", "plate_h", F.greatest(F.lit(0), F.col("top") - pad).alias("a"), F.least(F.col("plate_h"), F.col("low") + pad).alias("b"), "top")
    some = F.col("top").isNotNull() & (F.col("b") - F.col("a") >= 3)
    return y.select("crop_id", F.when(some, F.col("a")).otherwise(0).alias("y0"), F.when(some, F.col("b")).otherwise(F.col("plate_h")).alias("y1"))


def plate_body(components: DataFrame) -> DataFrame:
    """The largest component, or the whole crop where that is too small."""
    best = components.groupBy("crop_id", "plate_w", "plate_h").agg(F.max_by(F.struct("x", "y", "w", "h"), F.struct("area", -F.col("comp_id"))).alias("b"))
    small = (F.col("b.w") < F.col("plate_w") * F.lit(0.4)) | (F.col("b.h") < F.col("plate_h") * F.lit(0.3))
    pick = lambda c, full: F.when(small, full).otherwise(F.col(f"b.{c}")).alias(c)
    return best.select("crop_id", pick("x", F.lit(0)), pick("y", F.lit(0)), pick("w", F.col("plate_w")), pick("h", F.col("plate_h")))


def field_frames(cuts: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """Size of each field's frame for recognition; fields under three pixels have none."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f"{f}_end") - F.col(f"{f}_start")).alias("w"), F.col("plate_h").alias("h")) for f in ("digits", "letter", "region")))
    each = cuts.where("is_complete").select(*keys, F.inline(fields)).where(F.least("w", "h") >= 3)
    wide = F.greatest(F.lit(1), (F.col("w") * (F.lit(float(OCR_HEIGHT)) / F.col("h"))).cast("int"))
    return each.select(*keys, "field", (wide + 2 * OCR_MARGIN).alias("frame_w"), F.lit(OCR_HEIGHT + 2 * OCR_MARGIN).alias("frame_h"))


def ocr_frames(cuts: DataFrame, o: Options, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """Size of each field's and whole plate's frame for recognition, and of the enlarged plate that bars are looked for in."""
    sized = lambda name, by: F.struct(F.lit(name).alias("field"), *((F.col(f"plate_{s}") * F.lit(by)).cast("int").alias(f"frame_{s}") for s in "wh"))
    plates = F.array(sized("whole", o.ocr_upscale), sized("working", float(WORKING_SCALE)))
    return field_frames(cuts, keys).unionByName(cuts.select(*keys, F.inline(plates)))


# Names of the renderings that a recogniser is shown.
FIELD_RENDERINGS = ("field", "field_clahe", "field_otsu", "field_adaptive", "field_sharp")
WHOLE_RENDERINGS = ("colour", "grey", "clahe", "otsu", "adaptive", "otsu_inverted", "sharpened")


def field_tasks(frames: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    names = F.posexplode(F.array(*map(F.lit, FIELD_RENDERINGS))).alias("k", "rendering")
    return frames.where("field not in ('whole', 'working')").select(*keys, "field", names).select(*keys, "field", (F.col("k") + 1).alias("variant_no"), "rendering")


def whole_tasks(frames: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    names = F.posexplode(F.array(*map(F.lit, WHOLE_RENDERINGS))).alias("k", "rendering")
    each = frames.where("field = 'whole'").select(*keys, names).select(*keys, (F.col("k") + 1).alias("variant_no"), "rendering")
    return each.withColumn("restricted", F.explode(F.array(F.lit(True), F.lit(False))))


def field_calls(frames: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """A recogniser's tasks of fields, each with the alphabet that its answer is restricted to."""
    return field_tasks(frames, keys).withColumn("alphabet", F.when(F.col("field") == "letter", "letters").otherwise("digits"))


def whole_calls(frames: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """Those of whole plates."""
    return whole_tasks(frames, keys).select(*keys, F.lit("whole").alias("field"), "variant_no", "rendering", F.when(F.col("restricted"), "both").otherwise("any").alias("alphabet"))


def ocr_tasks(frames: DataFrame, keys: tuple[str, ...] = ("crop_id",)) -> DataFrame:
    """All tasks of a recogniser."""
    return field_calls(frames, keys).unionByName(whole_calls(frames, keys))


def otsu_threshold(levels: DataFrame) -> DataFrame:
    """For each group, the level that parts it with the largest variance between the sides, and how many rows lie above."""
    n = levels.groupBy("grp", "level").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("grp").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp")
    mass = F.col("n") * F.col("level")
    c = n.select("grp", "level", F.sum("n").over(upto).alias("w0"), F.sum(mass).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(mass).over(whole).alias("s"))
    d = {k: F.col(k).cast("double") for k in ("w0", "s0", "w", "s")}
    rest = d["w"] - d["w0"]
    gap = d["s0"] / d["w0"] - (d["s"] - d["s0"]) / F.nullif(rest, F.lit(0.0))
    var = F.round(F.coalesce(d["w0"] / d["w"] * (rest / d["w"]) * gap * gap, F.lit(0.0)), 6)
    best = c.groupBy("grp").agg(F.max_by(F.struct("level", "w0", "w"), F.struct(var, -F.col("level"))).alias("b"))
    return best.select("grp", F.col("b.level").alias("threshold"), (F.col("b.w") - F.col("b.w0")).alias("n_above"))

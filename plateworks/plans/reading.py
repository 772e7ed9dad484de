"""From boxes and readings to one plate for each vehicle, and reports on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators import boxes as b
from ..operators import votes as v
from ..options import Options
from ..sources.saved import Dealt, large, saved

IMAGE = r"(?i)\.(jpg|jpeg|png|bmp|webp)$"


def manifest(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("path").rlike(IMAGE)).select("photo_id", "group_id", "position", "path")


def missing(photos: DataFrame, listing: DataFrame) -> DataFrame:
    return photos.join(large(listing), "photo_id", "left_anti").select("photo_id", "group_id", "path")


def detections(raw: DataFrame, photos: DataFrame, o: Options) -> DataFrame:
    return b.indexed(b.deduplicated(b.padded(b.confident(raw, o), photos, o), o))


def crop_manifest(found: DataFrame, photos: DataFrame) -> DataFrame:
    name = F.format_string("%02d_%s_plate%d.jpg", F.col("position"), stem(F.col("path")), F.col("det_index"))
    rows = found.join(large(photos.select("photo_id", "position", "path")), "photo_id")
    return rows.select("photo_id", "det_index", name.alias("name"), *b.BOX, (F.col("x2") - F.col("x1")).alias("crop_w"), (F.col("y2") - F.col("y1")).alias("crop_h"))


#: Readings, or a function that gives those of the detections (photo_id, det_seq) asked for.
Readings = DataFrame | Callable[[DataFrame], DataFrame]


def _of(readings: Readings, asked: DataFrame) -> DataFrame:
    return readings(asked) if callable(readings) else readings.join(large(asked), [*v.DETECTION], "left_semi")


def _done() -> Column:
    return F.coalesce(F.col("cut") & F.col("f_text").isNotNull(), F.lit(False))


def by_field(found: DataFrame, cuts: DataFrame, fields: Readings, o: Options, dealt: Dealt | None = None, key: str | None = None) -> DataFrame:
    """photo_id, det_seq, det_index, confidence, cut, digits, letter, region, f_text, f_weight, done: each detection and what its fields say.

    Fields count where a detection's plate could be cut. The rows are saved, as
    whole plates are asked for where they are not done. Here and below, ``dealt``
    says how detections and cuts are dealt by photo, and ``key`` by which column
    readings are, if they are.
    """
    own = [*v.DETECTION]
    complete = cuts.where("is_complete").select(*own, F.lit(True).alias("cut"))
    base = saved(found.select(*own, "det_index", "confidence").join(large(complete), own, "left"), "detections", dealt)
    # Fields are filtered before the costly part, the parsing of their readings.
    won = v.composed(_of(fields, base.where("cut").select(*own)), o, key)
    won = won.select(*own, "digits", "letter", "region", F.col("plate_text").alias("f_text"), F.col("score").alias("f_weight"))
    return saved(base.join(large(won), own, "left").withColumn("done", _done()), "by-field", dealt)


def with_whole(read: DataFrame, whole: Readings, o: Options, key: str | None = None) -> DataFrame:
    """The votes of :func:`routed_votes` from the rows of :func:`by_field` and readings of whole plates."""
    own = [*v.DETECTION]
    # Only detections that the fields left without a plate have whole votes.
    tally = v.whole_votes(_of(whole, read.where("not done").select(*own)), o, key)
    both = read.join(large(tally), own, "left")
    shown = lambda c: F.when(F.col("done"), F.col(c)).when(F.col("cut"), F.coalesce(c, F.lit("?"))).alias(c)
    pick = lambda own, other: F.when(F.col("done"), F.col(own)).otherwise(F.col(other)).alias(other)
    segmented = F.col("done") | F.coalesce(F.col("cut") & F.col("text").isNull(), F.lit(False))
    return both.select("photo_id", "det_index", segmented.alias("segmented"), shown("digits"), shown("letter"), shown("region"), pick("f_text", "text"), pick("f_weight", "weight"), F.coalesce("first_seq", F.lit(0)).alias("first_seq"), "confidence")


def routed_votes(found: DataFrame, cuts: DataFrame, fields: Readings, whole: Readings, o: Options, dealt: Dealt | None = None) -> DataFrame:
    """photo_id, det_index, segmented, digits, letter, region, text, weight, first_seq, confidence: votes that count, one row each.

    A detection's fields are read where its plate could be cut; the whole plate
    is read where it could not, or where its fields gave no plate but the whole
    does. A detection without votes has one row with a null text.
    """
    key = dealt and dealt[1]
    return with_whole(by_field(found, cuts, fields, o, dealt, key), whole, o, key)


def plate_readings(routed: DataFrame) -> DataFrame:
    """One row for each detection: its plate, score, method and field texts."""
    best = F.min_by(F.struct("text", "weight"), F.struct(-F.col("weight"), F.col("first_seq"))).alias("w")
    one = routed.groupBy("photo_id", "det_index", "segmented", "digits", "letter", "region", "confidence").agg(best)
    score = F.round(F.coalesce(F.col("w.weight") * F.col("confidence"), F.lit(0.0)), 12)
    return one.select("photo_id", "det_index", "segmented", "digits", "letter", "region", F.col("w.text").alias("plate_text"), F.coalesce("w.text", F.lit("unreadable")).alias("text"), score.alias("score"), F.col("confidence").alias("detector_confidence"))


def photo_best(readings: DataFrame) -> DataFrame:
    """The best reading of each photo: readable ones first, by score, then by the detector's confidence, then in order."""
    readable = F.col("plate_text").isNotNull()
    rank = F.struct(~readable, F.when(readable, -F.col("score")), F.when(readable, -F.col("detector_confidence")), F.col("det_index"))
    best = readings.groupBy("photo_id").agg(F.min_by(F.struct("det_index", "plate_text", "text", "score"), rank).alias("b"))
    return best.select("photo_id", "b.*")


def photo_results(photos: DataFrame, best: DataFrame, readings: DataFrame) -> DataFrame:
    """All photos, those without detection too."""
    n = readings.groupBy("photo_id").agg(F.count("*").alias("n_readings"))
    rows = photos.select("photo_id", "group_id", "position").join(large(best), "photo_id", "left").join(large(n), "photo_id", "left")
    return rows.select("photo_id", "group_id", "position", F.coalesce("n_readings", F.lit(0)).alias("n_readings"), "plate_text", "text")


def group_votes(routed: DataFrame, photos: DataFrame) -> DataFrame:
    """group_id, text, weight, first_seq (photo, detection, vote) over all votes of all photos of a vehicle."""
    rows = routed.where("text is not null").join(large(photos.select("photo_id", "group_id", "position")), "photo_id")
    seq = F.min(F.struct("position", "det_index", "first_seq"))
    return rows.groupBy("group_id", "text").agg(F.round(F.sum(F.col("weight") * F.col("confidence")), 12).alias("weight"), seq.alias("first_seq"))


def group_plate(votes: DataFrame, photos: DataFrame) -> DataFrame:
    groups = photos.select("group_id").distinct()
    return groups.join(large(v.winners(votes, "group_id")), "group_id", "left").select("group_id", F.col("text").alias("plate"), "score")


def agreement(plates: DataFrame, results: DataFrame) -> DataFrame:
    rows = results.select("group_id", "plate_text").join(large(plates.select("group_id", "plate")), "group_id")
    same = F.coalesce(F.col("plate_text") == F.col("plate"), F.lit(False))
    return rows.groupBy("group_id", "plate").agg(F.sum(same.cast("long")).alias("agreeing"), F.count("*").alias("n_images"))


def run_summary(agreed: DataFrame, gone: DataFrame) -> DataFrame:
    lost = gone.groupBy("group_id").agg(F.count("*").alias("n_missing"))
    found = F.col("plate").isNotNull()
    first = F.when(found, F.concat(F.lit("Plate: "), "plate")).otherwise("Plate: unreadable")
    second = F.when(found & (F.col("n_images") > 1), F.format_string("Agreement: %d/%d images", "agreeing", "n_images"))
    status = F.when(F.col("n_missing") > 0, 2).when(found, 0).otherwise(1)
    rows = agreed.join(large(lost), "group_id", "left")
    return rows.select("group_id", "plate", "agreeing", "n_images", status.alias("status"), first.alias("line"), second.alias("agreement_line"))


def activity_log(photos: DataFrame, readings: DataFrame) -> DataFrame:
    """A line for each photo, followed by one for each of its detections, or one that says there is none."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    how = F.when(F.col("segmented"), "fields").otherwise("whole plate")
    # Two decimals, ties to even, as the confidence's binary value is exact.
    said = F.format_string("  plate %d: %s [%s, detector %.2f]", "det_index", "text", how, F.bround("detector_confidence", 2))
    key = ["photo_id", "group_id", "position"]
    begun = photos.select(*key, F.lit(1).alias("line_no"), F.concat(F.lit("Detecting plates in "), name, F.lit("...")).alias("line"))
    line = F.when(F.col("text").isNull(), F.concat(F.lit("  no plate found in "), name)).otherwise(said)
    then = photos.join(large(readings), "photo_id", "left").select(*key, (F.coalesce("det_index", F.lit(1)) + 1).alias("line_no"), line.alias("line"))
    return begun.unionByName(then)


def report_rows(photos: DataFrame, readings: DataFrame, found: DataFrame) -> DataFrame:
    method = F.when(F.col("segmented"), "fields").otherwise("whole_plate")
    rows = photos.select("photo_id", "group_id", "position", "path").join(large(readings), "photo_id").join(large(found.select("photo_id", "det_index", *b.BOX)), ["photo_id", "det_index"])
    return rows.select("group_id", "position", "path", "det_index", "text", F.round("detector_confidence", 4).alias("detector_confidence"), *b.BOX, F.round(F.col("score").cast("decimal(24,12)"), 4).cast("double").alias("score"), method.alias("method"), "digits", "letter", "region")


def report_json(photos: DataFrame, rows: DataFrame, agreed: DataFrame) -> DataFrame:
    """One JSON document for each vehicle, which holds all its photos and their plates: as large as a vehicle's run."""
    fields = F.when(F.col("digits").isNotNull(), F.struct("digits", "letter", "region"))
    plate = F.struct("text", "detector_confidence", F.array(*b.BOX).alias("box"), "score", "method", fields.alias("fields"))
    plates = rows.groupBy("group_id", "position").agg(F.array_sort(F.collect_list(F.struct("det_index", plate.alias("plate")))).alias("l"))
    image = F.struct("position", F.struct("path", F.coalesce("l.plate", F.array()).alias("plates")).alias("image"))
    images = photos.select("group_id", "position", "path").join(large(plates), ["group_id", "position"], "left").groupBy("group_id").agg(F.array_sort(F.collect_list(image)).alias("l"))
    text = F.coalesce("plate", F.lit("unreadable"))
    whole = F.struct(text.alias("plate"), F.col("plate").isNotNull().alias("found"), F.col("agreeing").alias("images_agreeing"), F.col("l.image").alias("images"))
    return images.join(large(agreed), "group_id").select("group_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def preview_pick(results: DataFrame) -> DataFrame:
    """The first photo of each vehicle that has a reading."""
    return results.where("n_readings > 0").groupBy("group_id").agg(F.min_by(F.struct("photo_id", "text"), "position").alias("p")).select("group_id", "p.photo_id", "p.text")


def votes_map(votes: DataFrame) -> DataFrame:
    """A map from text to weight for each vehicle; as many entries as it has different texts."""
    return votes.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "weight")))).alias("votes"))

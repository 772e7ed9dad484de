"""Weighted votes over readings, for fields, detections and vehicles.

A vote is a sum of weights for each text, taken with partial aggregation; the
winner has the largest sum, and the text seen first on a tie. Sums are rounded
before they are compared, so their order of addition does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTERS, held, reject_reason, with_normal_text, with_plate
from ..options import Options

MAX_DIGITS = {"digits": 5, "region": 2}
FIELDS = ("digits", "letter", "region")


def weight(o: Options) -> Column:
    return F.greatest(F.col("confidence"), F.lit(o.weight_floor))


#: Unicode's white space.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean(readings: DataFrame) -> DataFrame:
    """Readings with text, trimmed."""
    return held(readings, raw_text=F.btrim("raw_text", F.lit(BLANKS))).where("raw_text <> ''")


#: What a recogniser may answer for each field when it is restricted.
ALPHABETS = {"digits": "0123456789W", "letter": LETTERS, "region": "0123456789W", "whole": f"0123456789{LETTERS}W"}


def alphabet_violations(readings: DataFrame) -> DataFrame:
    """How many readings of each field, restricted or not, have characters outside its alphabet."""
    beyond = F.lit(None).cast("string")
    for field, alphabet in ALPHABETS.items():
        beyond = F.when(F.col("field") == field, F.translate("raw_text", alphabet, "")).otherwise(beyond)
    return readings.groupBy("field", "restricted").agg(F.count("*").alias("n"), F.sum((beyond != "").cast("long")).alias("n_violations"))


def parsed(readings: DataFrame, key: str | None = None) -> DataFrame:
    return with_plate(with_normal_text(readings, "raw_text", key=key))


def rejects(readings: DataFrame) -> DataFrame:
    reason = parsed(readings).select(reject_reason(F.col("normal_text"), F.col("plate_text")).alias("reason"))
    return reason.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


#: What names a detection, from the first reading to the vote.
DETECTION = ("photo_id", "det_seq")


def winners(votes: DataFrame, *keys: str) -> DataFrame:
    """keys, text, score of each key's winner."""
    best = votes.groupBy(*keys).agg(F.min_by(F.struct("text", "weight"), F.struct(-F.col("weight"), F.col("first_seq"))).alias("b"))
    return best.select(*keys, F.col("b.text").alias("text"), F.col("b.weight").alias("score"))


def _tally(rows: DataFrame, each: Column, seq: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "text").agg(F.round(F.sum(each), 6).alias("weight"), F.min(seq).alias("first_seq"))


def field_votes(readings: DataFrame, o: Options, key: str | None = None) -> DataFrame:
    """Detection, field, text, weight, first_seq of readings of all three fields.

    A number or region votes as a whole, if it is all digits and not too long.
    Each plate letter in a reading of the letter votes, as often as it occurs.
    Readings of one raw text are added up before that is made canonical. Here
    and below, ``key`` names the column that readings are dealt by, if they are.
    """
    alike = readings.groupBy(*DETECTION, "field", "raw_text").agg(F.sum(weight(o)).alias("each"), F.min("variant_no").alias("variant_no"))
    normal = with_normal_text(alike, "raw_text", "text", key).select(*DETECTION, "field", "variant_no", "each", "text")
    size = F.when(F.col("field") == "digits", MAX_DIGITS["digits"]).otherwise(MAX_DIGITS["region"])
    number = (F.col("field") != "letter") & F.col("text").rlike(r"^\p{Nd}+$") & (F.length("text") <= size)
    letters = F.when(F.col("text").isin(*LETTERS), F.array("text")).otherwise(F.filter(F.split("text", ""), lambda c: c.isin(*LETTERS)))
    texts = F.when(F.col("field") == "letter", letters).when(number, F.array("text"))
    each = normal.select(*DETECTION, "field", "variant_no", "each", F.posexplode(texts).alias("k", "text"))
    # A number, so that votes are added up in hash tables: the rendering, then the place in its text.
    return _tally(each, F.col("each"), F.shiftleft(F.col("variant_no").cast("long"), 32) + F.col("k"), *DETECTION, "field")


def field_winners(readings: DataFrame, o: Options, field: str, key: str | None = None) -> DataFrame:
    """Detection, text, score of one field."""
    return winners(field_votes(readings.where(F.col("field") == field), o, key), *DETECTION)


def whole_votes(readings: DataFrame, o: Options, key: str | None = None) -> DataFrame:
    rows = parsed(readings, key).where("plate_text is not null").withColumn("text", F.col("plate_text"))
    return _tally(rows, weight(o), F.col("reading_seq"), *DETECTION)


def composed(readings: DataFrame, o: Options, key: str | None = None) -> DataFrame:
    """Detection, digits, letter, region, plate_text, score: the three fields' winners put together."""
    # The winners of all fields in one aggregation by detection; a vote of another field has no rank.
    rank = lambda f: F.when(F.col("field") == f, F.struct(-F.col("weight"), F.col("first_seq")))
    best = [F.min_by(F.struct("text", "weight"), rank(f)).alias(f"_{f}") for f in FIELDS]
    wide = field_votes(readings, o, key).groupBy(*DETECTION).agg(*best)
    texts, (d, l, g) = [F.col(f"_{f}.text").alias(f) for f in FIELDS], (F.col(f"_{f}.weight") for f in FIELDS)
    wide = wide.select(*DETECTION, *texts, F.round(d + l + g, 6).alias("score"))
    whole = F.when(F.col("score").isNotNull(), F.concat_ws("-", *FIELDS))
    return wide.select(*DETECTION, *FIELDS, whole.alias("plate_text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def pooled(fields: DataFrame, whole: DataFrame) -> DataFrame:
    """Readings of all renderings in one bag."""
    f = fields.select(*DETECTION, F.lit("fields").alias("source"), "field", F.col("variant_no").alias("seq"), "restricted", "raw_text", "confidence")
    w = whole.select(*DETECTION, F.lit("whole").alias("source"), F.lit("whole").alias("field"), F.col("reading_seq").alias("seq"), "restricted", "raw_text", "confidence")
    return f.unionByName(w)

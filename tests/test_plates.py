"""Plate text, boxes and votes on small hand-made tables, and the registered queries' names."""

import json
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plateworks.functions import text as tx
from plateworks.functions.boxes import slice_end
from plateworks.operators import boxes, stages, votes
from plateworks.options import Options
from plateworks.plans import reading
from plateworks.sources import tables
from plateworks.streaming.votes import windowed_votes

O = Options()
ALEF, BA, DAL, HA, WAW, TAH = "\u0623", "\u0628", "\u062f", "\u0647", "\u0648", "\u0637"
#: Rule -> texts and the plate they mean.
CASES = {
    "separators": ([f"9071-{BA}-6", f"9071 {BA} 6", f"9071{BA}6", f"9071/{BA}.6", f"9071\u2014{BA}\u06406", f"  9071 --{BA}_ 6 -", f"9071\u00a0{BA}\u20036"], f"9071-{BA}-6"),
    "digits": ([f"\u0663\u0665{DAL}\u0668\u0669", f"\u06f3\u06f5-{DAL}-\u06f8\u06f9", f"\uff13\uff15-{DAL}-89"], f"35-{DAL}-89"),
    "letters": ([f"602-{x}-17" for x in (TAH, "\u0638", "\ufec1")], f"602-{TAH}-17"),
    "waw": ([f"4-{x}-3" for x in (WAW, "\u0624", "\ufeed")], f"4-{WAW}-3"),
    "decomposed": ([f"88-{unicodedata.normalize('NFKD', ALEF)}-40", "88-\u0627\u064e-40"], f"88-{ALEF}-40"),
    "lookalikes": ([f"SBOI4-{HA}-zT", f"5B0l4-{HA}-2t"], f"58014-{HA}-27"),
    "hidden": ([f"\u200e77\u200f1\t-{DAL}\n-5\x00"], f"771-{DAL}-5"),
    "temporary": (["640219 WW", "64 02 19ww", "640219-wW", "G40Z19WW"], "640219 WW"),
    "none": ([None, "", " \n", "-/-", "WW", "12345", f"{BA}", f"123456-{BA}-1", f"12-{BA}-345", f"12-{BA}", f"12-{BA}-{BA}-3", f"1 2-{BA}-3", "12-\u0632-3", "1234WW", "1234567WW", f"1X2-{BA}-3", "WW123456"], None),
}


def _model(raw):
    """The rules for one text, in plain Python: canonical text and plate."""
    fold = dict(zip(tx.FOLD_FROM, tx.FOLD_TO, strict=True))
    kept = [c for c in unicodedata.normalize("NFKD", raw or "") if not unicodedata.combining(c) and unicodedata.category(c)[0] != "C"]
    normal = "".join(fold.get(c, c) for c in kept).upper()
    normal = " ".join(normal.split())
    while "--" in normal:
        normal = normal.replace("--", "-")
    normal = normal.strip(" -")
    digits = lambda t: "".join(dict(zip(*tx.LOOKALIKES, strict=True)).get(c, c) for c in t)
    at = [k for k, c in enumerate(normal) if c in tx.LETTERS]
    if len(at) == 1:
        left, right = normal[: at[0]].rstrip(" -"), normal[at[0] + 1 :].lstrip(" -")
        if 1 <= len(left) <= 5 and 1 <= len(right) <= 2 and not set(left + right) & {" ", "-"}:
            left, right = digits(left), digits(right)
            return normal, f"{left}-{normal[at[0]]}-{right}" if (left + right).isdecimal() else None
    tight = normal.replace(" ", "")
    head = tight[:-2].removesuffix("-") if tight.endswith("WW") else ""
    if 5 <= len(head) <= 6 and "-" not in head and digits(head).isdecimal():
        return normal, f"{digits(head)} WW"
    return normal, None


def _parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, raw string")
    rows = {r.k: r for r in tx.with_plate(tx.with_normal_text(df, "raw")).collect()}
    return [rows[k] for k in range(len(texts))]


@pytest.mark.parametrize("rule", CASES)
def test_plate_texts(spark, rule):
    texts, want = CASES[rule]
    got = _parse(spark, texts)
    assert [r.plate_text for r in got] == [want] * len(texts)
    if want:
        parts = tuple(want.split("-")) if "-" in want else (want[:-3], None, None)
        assert {(r.digits, r.letter, r.region, r.is_temporary) for r in got} == {(*parts, "WW" in want)}


def test_random_texts_equal_the_model(spark):
    rng = random.Random(11)
    parts = [*"0123456789OIZ|wW -/_\t", *tx.LETTERS, "\u0627", "\u0665", "\u00e9", "\u0632", "\ufb01", "\u0301", "\ufe0f", "\u20e3", "\u034f", "\U000e0100", "\U0001f1e6", "WW", "-", " ", "12", "345"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += [f"{rng.randrange(10 ** rng.randrange(1, 7))}{rng.choice(parts)}{rng.choice(tx.LETTERS)}{rng.choice(parts)}{rng.randrange(120)}" for _ in range(1500)]
    got = [(r.normal_text, r.plate_text) for r in _parse(spark, texts)]
    want = [_model(t) for t in texts]
    assert got == want and sum(p is not None for _, p in want) > 150


def test_marks_without_a_class_stay_and_others_go(spark):
    marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M" and unicodedata.normalize("NFKD", chr(c)) == chr(c)]
    got = [r.normal_text for r in _parse(spark, [f"12{m}3" for m in marks])]
    want = [_model(f"12{m}3")[0] for m in marks]
    kept = [g for g in got if g != "123"]
    assert got == want and len(kept) == sum(not unicodedata.combining(m) for m in marks) > 1400


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "photo_id long, det_seq int, x1 int, y1 int, x2 int, y2 int, confidence double")


def test_suppression_keeps_the_surer_box_and_drops_at_the_limit(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.5), (1, 2, 0, 0, 10, 6, 0.9), (1, 3, 0, 0, 10, 5, 0.4), (2, 1, 0, 0, 4, 4, 0.3)]
    kept = {(r.photo_id, r.det_seq) for r in boxes.deduplicated(_boxes(spark, rows), O).collect()}
    assert kept == {(1, 2), (2, 1)}  # box 1 overlaps box 2 by exactly 0.6
    assert {(r.a_seq, r.b_seq) for r in boxes.overlap_pairs(_boxes(spark, rows), O).collect()} == {(1, 2), (2, 3)}


def test_padding_truncates_and_clamps(spark):
    raw = spark.createDataFrame([(1, 1, -4.0, 10.0, 96.0, 60.0, 0.5), (1, 2, 700.0, 0.0, 800.0, 9.0, 0.5)], "photo_id long, det_seq int, x1 double, y1 double, x2 double, y2 double, confidence double")
    (r,) = boxes.padded(raw, spark.createDataFrame([(1, 640, 480)], "photo_id long, img_w int, img_h int"), O).collect()
    assert (r.x1, r.y1, r.x2, r.y2) == (0, 6, 104, 64)


FIELD = "photo_id long, det_seq int, field string, variant_no int, raw_text string, confidence double"
WHOLE = "photo_id long, det_seq int, reading_seq int, raw_text string, confidence double"


def test_ties_go_to_the_text_seen_first_and_weights_have_a_floor(spark):
    rows = [(1, 1, "digits", 1, "22", 0.5), (1, 1, "digits", 2, "11", 0.5), (2, 1, "digits", 1, "7", 0.0), (2, 1, "digits", 2, "123456", 0.9), (2, 2, "digits", 1, "8", 0.25)]
    won = {(r.photo_id, r.det_seq): (r.text, r.score) for r in votes.field_winners(spark.createDataFrame(rows, FIELD), O, "digits").collect()}
    assert won == {(1, 1): ("22", 0.5), (2, 1): ("7", 0.01), (2, 2): ("8", 0.25)}


def test_letters_vote_once_an_occurrence(spark):
    rows = [(1, 1, "letter", 1, f"{BA}x{BA}", 0.25), (1, 1, "letter", 2, ALEF, 0.375), (2, 1, "letter", 1, f"{DAL}{BA}", 0.5)]
    won = {r.photo_id: (r.text, r.score) for r in votes.field_winners(spark.createDataFrame(rows, FIELD), O, "letter").collect()}
    assert won == {1: (BA, 0.5), 2: (DAL, 0.5)}


def _fields(photo, det, digits, letter, region):
    return [(photo, det, f, 1, t, 0.5) for f, t in (("digits", digits), ("letter", letter), ("region", region)) if t]


def test_each_detection_takes_its_way_and_photos_and_vehicles_add_up(spark):
    found = spark.createDataFrame([(1, 4, 1, 0.5), (1, 2, 2, 0.5), (1, 7, 3, 0.25), (2, 1, 1, 0.5), (2, 3, 2, 0.5), (3, 1, 1, 0.5)], "photo_id long, det_seq int, det_index int, confidence double")
    cuts = spark.createDataFrame([(1, 4, True), (1, 2, True), (1, 7, True), (2, 1, False), (2, 3, True), (3, 1, False)], "photo_id long, det_seq int, is_complete boolean")
    fields = _fields(1, 4, "71", BA, "2") + _fields(1, 2, "9", None, "3") + _fields(1, 7, None, None, None) + _fields(2, 1, "55", DAL, "5") + _fields(2, 3, "71", BA, "2")
    whole = [(1, 4, 1, f"1{BA}1", 0.9), (1, 2, 1, f"8{DAL}8", 0.5), (1, 2, 2, f"6{DAL}6", 0.5), (1, 7, 1, "nothing", 0.9), (2, 1, 1, f"71-{BA}-2", 0.75), (3, 1, 1, "?", 0.5)]
    routed = reading.routed_votes(found, cuts, spark.createDataFrame(fields, FIELD), spark.createDataFrame(whole, WHOLE), O)
    read = reading.plate_readings(routed)
    got = {(r.photo_id, r.det_index): (r.segmented, r.digits, r.letter, r.region, r.text, r.score) for r in read.collect()}
    assert got == {
        (1, 1): (True, "71", BA, "2", f"71-{BA}-2", 0.75),  # cut, fields read
        (1, 2): (False, "9", "?", "3", f"8-{DAL}-8", 0.25),  # cut, fields fail, whole read: first of two equal votes
        (1, 3): (True, "?", "?", "?", "unreadable", 0.0),  # cut, neither read
        (2, 1): (False, None, None, None, f"71-{BA}-2", 0.375),  # not cut, whole read
        (2, 2): (True, "71", BA, "2", f"71-{BA}-2", 0.75),
        (3, 1): (False, None, None, None, "unreadable", 0.0),  # not cut, not read
    }
    photos = spark.createDataFrame([(1, 9, 1, "/a/x.jpg"), (2, 9, 2, "/a/y.jpg"), (3, 9, 3, "/a/z.jpg"), (4, 8, 1, "/b/w.jpg")], "photo_id long, group_id long, position int, path string")
    best = reading.photo_best(read)
    assert {r.photo_id: (r.det_index, r.text) for r in best.collect()} == {1: (1, f"71-{BA}-2"), 2: (2, f"71-{BA}-2"), 3: (1, "unreadable")}
    tally = reading.group_votes(routed, photos)
    assert {(r.group_id, r.text): r.weight for r in tally.collect()} == {(9, f"71-{BA}-2"): 1.875, (9, f"8-{DAL}-8"): 0.25, (9, f"6-{DAL}-6"): 0.25}
    agreed = reading.agreement(reading.group_plate(tally, photos), reading.photo_results(photos, best, read))
    assert {(r.group_id, r.plate, r.agreeing, r.n_images) for r in agreed.collect()} == {(9, f"71-{BA}-2", 2, 3), (8, None, 0, 1)}
    lines = [r.line for r in reading.activity_log(photos, read).orderBy("photo_id", "line_no").collect()]
    assert lines[:4] == ["Detecting plates in x.jpg...", f"  plate 1: 71-{BA}-2 [fields, detector 0.50]", f"  plate 2: 8-{DAL}-8 [whole plate, detector 0.50]", "  plate 3: unreadable [fields, detector 0.25]"]
    assert lines[-2:] == ["Detecting plates in w.jpg...", "  no plate found in w.jpg"]
    framed = found.select("photo_id", "det_index", *(F.lit(k).alias(c) for k, c in enumerate(boxes.BOX)))
    documents = {r.group_id: json.loads(r.document) for r in reading.report_json(photos, reading.report_rows(photos, read, framed), agreed).collect()}
    assert [len(i["plates"]) for i in documents[9]["images"]] == [3, 2, 1] and documents[8] == {"plate": "unreadable", "found": False, "images_agreeing": 0, "images": [{"path": "/b/w.jpg", "plates": []}]}
    assert documents[9]["images"][0]["plates"][0] == {"text": f"71-{BA}-2", "detector_confidence": 0.5, "box": [0, 1, 2, 3], "score": 0.75, "method": "fields", "fields": {"digits": "71", "letter": BA, "region": "2"}}


def test_slice_ends_and_stems(spark):
    df = spark.createDataFrame([(-5, 100, "/a/b.c.jpg"), (120, 100, "x"), (7, 100, "/d.e/f.png")], "e int, w int, p string")
    assert [tuple(r) for r in df.select(slice_end(F.col("e"), F.col("w")), tx.stem(F.col("p"))).collect()] == [(95, "b.c"), (100, "x"), (7, "f")]


def test_frames_follow_the_upscale_option(spark):
    cuts = spark.createDataFrame([(1, 400, 100, 0, 200, 220, 222, 240, 400, True)], "crop_id long, plate_w int, plate_h int, digits_start int, digits_end int, letter_start int, letter_end int, region_start int, region_end int, is_complete boolean")
    got = {r.field: (r.frame_w, r.frame_h) for r in boxes.ocr_frames(cuts, Options(ocr_upscale=2.5)).collect()}
    assert got == {"digits": (400, 240), "region": (336, 240), "whole": (1000, 250), "working": (2400, 600)}  # the letter is too narrow


def test_recogniser_reads_tasks_and_failed_rows_are_reported(spark):
    with pytest.raises(ValueError, match="echo"):
        stages.backend("none")
    assert stages.backends() == ["echo"]
    frames = spark.createDataFrame([(k, f) for k in (10, 11) for f in ("digits", "letter", "region", "whole", "working")], "crop_id long, field string")
    tasks = boxes.ocr_tasks(frames)
    assert {(r.field, r.alphabet) for r in tasks.collect()} == {("digits", "digits"), ("letter", "letters"), ("region", "digits"), ("whole", "both"), ("whole", "any")}
    got = stages.run(tasks, stages.backend("echo"), stages.READING)
    assert got.columns == [*tasks.columns, "reading_seq", "raw_text", "confidence", "error"]
    rows = got.collect()
    assert len(rows) == tasks.count() == 2 * (15 + 14)
    assert {(r.crop_id, r.variant_no) for r in rows if r.error} == {(11, 1)} and {r.error for r in rows if r.error} == {"ValueError: no image"}
    assert {r.raw_text for r in rows if r.crop_id == 10 and r.field == "digits"} == {"10010"}
    assert stages.run(tasks.limit(0), stages.backend("echo"), stages.READING).count() == 0


def test_recogniser_may_find_none_or_several_and_must_answer_each_row(spark):
    tasks = spark.createDataFrame([(k,) for k in range(4)], "k int")
    several = stages.run(tasks, lambda: lambda f: [[(str(k), 0.5)] * int(k) for k in f.k], stages.READING).collect()
    assert sorted((r.k, r.reading_seq) for r in several) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
    short = stages.run(tasks, lambda: lambda f: [], stages.READING).collect()
    assert {r.error for r in short} == {"ValueError: 0 results for 1 tasks"} and len(short) == 4


def test_alphabets(spark):
    rows = [("digits", True, "12W"), ("digits", True, "1X"), ("letter", True, BA), ("letter", True, "1"), ("whole", True, f"12{BA}3W"), ("whole", False, f"12-{BA}-3")]
    got = {(r.field, r.restricted): (r.n, r.n_violations) for r in votes.alphabet_violations(spark.createDataFrame(rows, "field string, restricted boolean, raw_text string")).collect()}
    assert got == {("digits", True): (2, 1), ("letter", True): (2, 1), ("whole", True): (1, 0), ("whole", False): (1, 1)}


def test_user_tables_are_cast_and_checked(spark, tmp_path):
    pd.DataFrame({"photo_id": ["3"], "det_seq": [1], "x1": [1], "y1": [2], "x2": [3], "y2": [4], "confidence": ["0.5"], "more": [0]}).to_csv(tmp_path / "b.csv", index=False)
    df = tables.table(spark, str(tmp_path / "b.csv"), tables.BOXES, "csv", header="true")
    assert dict(df.dtypes) == tables.BOXES and df.first().confidence == 0.5
    with pytest.raises(ValueError, match="reading_seq, restricted, raw_text"):
        tables.table(spark, str(tmp_path / "b.csv"), tables.WHOLE_READINGS, "csv", header="true")
    (tmp_path / "in").mkdir()
    for name in ("a.JPG", "b.txt"):
        (tmp_path / "in" / name).write_bytes(b"xy")
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in tables.photo_files(spark, str(tmp_path)).collect()] == [("a.JPG", b"xy")]


def test_stream_of_readings_votes_in_windows(spark, tmp_path):
    rows = [(5, f"71{BA}2", 0.5, "2024-01-01 10:05:00"), (5, f"71-{BA}-2", 0.25, "2024-01-01 10:50:00"), (5, "no plate", 0.9, "2024-01-01 10:10:00"), (5, f"8{DAL}8", 0.0, "2024-01-01 11:01:00")]
    df = spark.createDataFrame(rows, "group_id long, raw_text string, confidence double, at string").select("group_id", "raw_text", "confidence", F.to_timestamp("at").alias("captured_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_votes(stream, O).writeStream.format("memory").queryName("won").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(str(r.window.start), r.group_id, r.text): r.weight for r in spark.table("won").collect()}
    assert got == {("2024-01-01 10:00:00", 5, f"71-{BA}-2"): 0.75, ("2024-01-01 11:00:00", 5, f"8-{DAL}-8"): 0.01}


def test_options_ignore_bad_numbers(spark):
    spark.conf.set("spark.plateworks.confidence", "much")
    spark.conf.set("spark.plateworks.ocr_upscale", "3")
    assert (Options.of(spark).confidence, Options.of(spark).ocr_upscale) == (0.25, 3.0)
    spark.conf.unset("spark.plateworks.confidence")
    spark.conf.unset("spark.plateworks.ocr_upscale")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

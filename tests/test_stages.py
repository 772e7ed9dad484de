"""Hooks: options, failing rows, nested tasks, batches bounded in bytes, child processes, and two-phase recognition."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plateworks.operators import boxes, stages
from plateworks.options import Options
from plateworks.plans import reading, staged

O = Options()
TASK = "photo_id long, det_seq int, field string, variant_no int, rendering string, alphabet string"


def test_options_make_different_backends_in_one_job(spark):
    tasks = spark.createDataFrame([(5, 1, "digits", 2, "field", "digits")], TASK)
    one, two = (stages.run(tasks, stages.backend("echo", seed=s), stages.READING) for s in (3, 4))
    assert {r.raw_text for r in one.union(two).collect()} == {str(10000 + 5001 + 3), str(10000 + 5001 + 4)}
    with pytest.raises(TypeError, match="colour"):
        stages.backend("echo", colour="red")


def test_a_worker_makes_a_backend_once():
    made = []
    ready = stages.Configured(lambda size: made.append(size) or (lambda frame: size), {"size": 4})
    assert ready() is ready() and made == [4]
    assert stages.Configured(lambda: object(), {})() is not stages.Configured(lambda: object(), {})()


def test_no_row_is_read_twice_by_a_yielding_backend_nor_thrice_by_another():
    frame = pd.DataFrame({"k": range(7)})
    read = []

    def one(rows):
        for k in rows.k:
            read.append(k)
            if k in (2, 3, 6):
                raise ValueError(k)
            yield [(k,)]

    assert stages.answers(one, frame) == [[(0,)], [(1,)], "ValueError: 2", "ValueError: 3", [(4,)], [(5,)], "ValueError: 6"] and read == list(range(7))
    read.clear()

    def whole(rows):
        return list(one(rows))

    assert stages.answers(whole, frame) == stages.answers(one, frame)
    read.clear()
    stages.answers(whole, frame)
    assert max(read.count(k) for k in range(7)) == 2
    assert stages.answers(lambda rows: iter([[]] * 9), frame) == ["ValueError: 9 results for 1 tasks"] * 7


def test_nested_tasks_share_their_crop_and_bytes_go_no_further(spark):
    crops = spark.createDataFrame([(1, bytearray(b"ab"), [("x", 1), ("y", 2)]), (2, bytearray(b"c"), []), (3, None, [("z", 3)])], "crop_id long, crop binary, tasks array<struct<field:string,variant_no:int>>")

    def make():
        return lambda frame: [[(f"{len(t.crop)}{t.field}", t.variant_no / 2)] for t in frame.itertuples()]

    out = stages.run(crops, make, stages.READING, unseen=("crop",), each="tasks")
    assert out.columns == ["crop_id", "field", "variant_no", "reading_seq", "raw_text", "confidence", "error"]
    got = {(r.crop_id, r.field): (r.raw_text, r.confidence, r.error) for r in out.collect()}
    assert got[1, "x"] == ("2x", 0.5, None) and got[1, "y"] == ("2y", 1.0, None) and got[3, "z"][2].startswith("TypeError") and len(got) == 3


def test_batches_are_bounded_in_bytes(spark):
    sizes = [1 << 20] * 12 + [50 << 20] + [1 << 20] * 3
    photos = spark.createDataFrame(list(enumerate(sizes)), "k int, n int").coalesce(1).select("k", F.expr("encode(repeat('x', n), 'utf-8')").alias("content"))
    make = lambda: lambda frame: [[(len(frame), sum(map(len, frame.content)))] for _ in range(len(frame))]
    got = stages.run(photos, make, "n int, rows int, bytes long", unseen=("content",)).collect()
    assert len(got) == 16 and {r.error for r in got} == {None}
    assert max(r.bytes for r in got if r.k < 8) <= 6 << 20 and max(r.bytes for r in got) <= (50 << 20) + (6 << 20)


def _fragile(yields):
    def make():
        def one(k):
            if k == 3:
                os._exit(7)
            if k == 5:
                time.sleep(60)
            if k == 6:
                raise ValueError("bad")
            print("said")  # must not mix with the answers
            return [(str(k), 0.5)]

        def steps(frame):
            for k in frame.k:
                yield one(k)

        return steps if yields else lambda frame: [one(k) for k in frame.k]

    return make


@pytest.mark.parametrize("yields", [True, False])
def test_exits_and_hangs_cost_their_rows_only(spark, yields):
    tasks = spark.createDataFrame([(k,) for k in range(9)], "k int").coalesce(1)
    rows = stages.run(tasks, stages.isolated(_fragile(yields), seconds=8), stages.READING).collect()
    got = {r.k: r.error or r.raw_text for r in rows}
    assert got == {**{k: str(k) for k in (0, 1, 2, 4, 7, 8)}, 3: "ChildProcessError: ended with 7", 5: "TimeoutError: no answer within 8 s", 6: "ValueError: bad"} and len(rows) == 9


def test_a_job_goes_on_where_it_ended(spark):
    tasks = spark.createDataFrame([(5, d, "digits", v, "field", "digits") for d in (1, 2) for v in (1, 2)], TASK)
    answered = stages.run(tasks.where("det_seq = 1"), stages.backend("echo"), stages.READING)
    assert {(r.det_seq, r.variant_no) for r in stages.remaining(tasks, answered, *tasks.columns[:4]).collect()} == {(2, 1), (2, 2)}


CUT = "photo_id long, det_seq int, plate_w int, plate_h int, digits_start int, digits_end int, letter_start int, letter_end int, region_start int, region_end int, is_complete boolean"
BAD_LETTER = 4  # its letter is too narrow to be shown


def test_whole_plates_are_read_only_where_fields_fail(spark):
    found = spark.createDataFrame([(1, d, d, 0.5) for d in range(1, 6)], "photo_id long, det_seq int, det_index int, confidence double")
    cuts = [(1, d, 400, 100, 0, 100, 110, 112 if d == BAD_LETTER else 150, 160, 400, d != 3) for d in (1, 2, 3, BAD_LETTER)]
    cuts.append((2, 9, 400, 100, 0, 100, 110, 150, 160, 400, True))  # of no detection
    asked = []

    def recogniser(tasks):
        asked.append(sorted({r.field for r in tasks.select("field").distinct().collect()}))

        def make():
            def read(frame):
                for t in frame.itertuples():
                    if t.det_seq == 2 and t.field == "letter":
                        yield []  # cut, but no letter
                    elif t.field == "whole":
                        yield [(f"1{boxes_letter}{t.det_seq}", 0.25), ("noise", 0.5)]
                    else:
                        yield [({"digits": "77", "letter": boxes_letter, "region": str(t.det_seq)}[t.field], 0.5)]

            return read

        return stages.run(tasks, make, stages.READING)

    boxes_letter = "ب"
    done = staged.staged(found, spark.createDataFrame(cuts, CUT), recogniser, O)
    calls = {r.det_index: (r.field_calls, r.whole_calls, r.calls) for r in done.calls().collect()}
    assert calls == {1: (15, 0, 15), 2: (15, 14, 29), 3: (0, 14, 14), BAD_LETTER: (10, 14, 24), 5: (0, 14, 14)}
    assert asked == [["digits", "letter", "region"], ["whole"]]
    read = {r.det_index: (r.segmented, r.text, r.letter) for r in done.readings().collect()}
    assert read == {1: (True, f"77-{boxes_letter}-1", boxes_letter), 2: (False, f"1-{boxes_letter}-2", "?"), 3: (False, f"1-{boxes_letter}-3", None), BAD_LETTER: (False, f"1-{boxes_letter}-4", "?"), 5: (False, f"1-{boxes_letter}-5", None)}
    assert done.quarantine().count() == 0


def test_answers_keep_the_order_of_calls(spark):
    rows = [(1, 1, "whole", 1, "any", 1, "a", 0.5, None), (1, 1, "whole", 1, "both", 2, "b", 0.5, None), (1, 1, "whole", 1, "both", 1, "c", 0.5, None), (1, 1, "whole", 2, "both", 1, "d", 0.5, None), (1, 1, "digits", 2, "digits", 1, "e", 0.5, None), (1, 1, "digits", 1, "digits", 2, "f", 0.5, None), (1, 1, "digits", 1, "digits", 0, None, None, "bad")]
    answers = spark.createDataFrame(rows, "photo_id long, det_seq int, field string, variant_no int, alphabet string, reading_seq int, raw_text string, confidence double, error string")
    assert [r.raw_text for r in staged.whole_texts(answers).orderBy("reading_seq").collect()] == ["c", "b", "a", "d"]
    assert [r.raw_text for r in staged.field_texts(answers).orderBy("variant_no").collect()] == ["f", "e"]


def test_tasks_and_frames_take_any_key(spark):
    cuts = spark.createDataFrame([(1, d, 400, 100, 0, 100, 110, 150, 160, 400, True) for d in (1, 2)], CUT)
    tasks = boxes.ocr_tasks(boxes.ocr_frames(cuts, O, staged.KEY), staged.KEY)
    assert {(r.photo_id, r.det_seq): r["count"] for r in tasks.groupBy(*staged.KEY).count().collect()} == {(1, 1): 29, (1, 2): 29}
    assert reading.v.DETECTION == staged.KEY

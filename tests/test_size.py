"""What keeps queries in bounds as their tables grow: no table of photos in the driver, no work done twice, tasks of bounded size."""

import os

import pytest
from pyspark.sql import functions as F

from plateworks.functions import text as tx
from plateworks.operators import boxes, crowded, votes
from plateworks.options import Options
from plateworks.plans import catalog
from plateworks.sources import fixtures
from plateworks.sources.saved import saved
from plateworks.streaming import plates

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["staged_calls", "staged_readings", "crowded_boxes", "group_votes", "agreement"])
def test_no_table_of_photos_goes_through_the_driver(spark, query):
    assert "Broadcast" not in _plan(catalog.QUERIES[query](spark, SF))


@pytest.mark.parametrize("query", ["agreement", "run_summary", "plate_report_json", "photo_results"])
def test_votes_needed_twice_are_read_from_files(spark, query):
    assert "ArrowEvalPython" not in _plan(catalog.QUERIES[query](spark, SF))


def test_a_round_makes_what_it_keeps_once(spark):
    row = [(1, k, 100 * k, 0, 100 * k + 50, 40, 0.5, -0.5) for k in range(4)] + [(1, 9, 2, 0, 52, 40, 0.25, -0.25)]
    left = spark.createDataFrame(row, "photo_id long, det_seq int, x1 int, y1 int, x2 int, y2 int, confidence double, rank double")
    kept = crowded._surest(left, Options())
    assert {r.det_seq for r in kept.collect()} == {0, 1, 2, 3} and "Join" not in _plan(kept)
    assert {(r.det_seq, r.kept) for r in crowded._decided(kept, left, Options()).collect()} == {(0, True), (1, True), (2, True), (3, True), (9, False)}


def test_ties_of_the_seventh_place_go_by_the_product(spark):
    rows = [(1, "a", 33.2990625), (1, "b", 0.0078125), (1, "c", 0.0), (2, "a", 0.5040625)]
    got = {r.group_id: r.votes for r in catalog._votes_json(spark.createDataFrame(rows, "group_id long, text string, weight double")).collect()}
    assert got == {1: '{"a":"33.299062","b":"0.007813","c":"0.000000"}', 2: '{"a":"0.504062"}'}


def test_whole_plates_are_not_asked_for_where_fields_are_wanted(spark, monkeypatch):
    asked = []
    run = catalog.stages.run
    monkeypatch.setattr(catalog.stages, "run", lambda tasks, *a: asked.append({r.field for r in tasks.select("field").distinct().collect()}) or run(tasks, *a))
    catalog.Tables(spark, SF).answered_fields()
    assert asked == [{"digits", "letter", "region"}]


def test_a_batch_of_a_stream_has_as_many_files_as_tasks_wrote(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 5 AS group_id", "cast(id + 1 as int) AS position", "cast(null as string) AS plate_text", f"cast(array() as {plates.VOTE}) AS votes").repartition(4)
    got = plates.in_batches(rows, str(tmp_path), 2).collect()
    assert {(r.group_id, r.n_images) for r in got} == {(k, 8) for k in range(5)}
    assert len([f for f in os.listdir(tmp_path / "photos") if f.endswith(".parquet")]) == 8 and len(os.listdir(tmp_path / "updates")) == 2


def test_tasks_have_bounded_numbers_of_lines(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_LINES", 500)
    lines = fixtures.lines(spark, SF)
    n = lines.count()
    assert lines.rdd.getNumPartitions() == -(-n // 500) > 4
    assert max(r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()) < 1500


def test_canonical_texts_are_those_that_folding_leaves(spark):
    texts = ["", None, "9071-ب-6", "640219 WW", "A1--B", "A- B", "-A", "A ", "a1", "٠", "A\u00a0B", "A-B C", "ا", "A\n", "1" * 5000, "-".join("7" * 5000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = tx.with_normal_text(df, "t", "n").select("t", "n", tx.fold(F.col("t")).alias("f"), F.col("t").rlike(tx.CANONICAL).alias("same")).collect()
    assert all(r.n == r.f for r in got) and {r.t for r in got if r.same} == {"9071-ب-6", "640219 WW", "A-B C", "1" * 5000, "-".join("7" * 5000)}
    blank = spark.createDataFrame([(f"{b}x y{b}{b}",) for b in votes.BLANKS] + [(votes.BLANKS,), (None,)], "raw_text string")
    assert {r.raw_text for r in votes.clean(blank).collect()} == {"x y"} and votes.clean(blank).count() == len(votes.BLANKS)


def test_readings_of_one_text_are_added_up_before_it_is_folded(spark):
    rows = [(1, 1, "digits", k, True, "12345", 0.25) for k in range(1, 6)] + [(1, 1, "letter", 1, True, "بب", 0.5), (1, 1, "letter", 2, True, "ب", None), (1, 1, "region", 2, True, "7", 0.5), (1, 1, "region", 1, True, "٨", 0.5)]
    rows += [(2, 1, "digits", 1, True, "12345", 0.5), (2, 1, "letter", 1, True, "ب", 0.5), (2, 1, "brand", 1, True, "7", 0.5)]
    readings = spark.createDataFrame(rows, "photo_id long, det_seq int, field string, variant_no int, restricted boolean, raw_text string, confidence double")
    won = votes.composed(readings, Options())
    below = _plan(won).split("ArrowEvalPython", 1)[1]
    assert "Aggregate" in below and "raw_text" in below.split("Aggregate", 1)[1].split("\n")[0]
    got = {r.photo_id: (r.digits, r.letter, r.region, r.plate_text, r.score) for r in won.collect()}
    # Two letters of one reading both vote, a tie goes to the earlier rendering, and another field is no part of a plate.
    assert got == {1: ("12345", "ب", "8", "12345-ب-8", 2.76), 2: ("12345", "ب", None, None, 0.0)}


def test_winners_of_all_fields_are_chosen_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, "digits", 1, True, "1", 0.5)], "photo_id long, det_seq int, field string, variant_no int, restricted boolean, raw_text string, confidence double").repartition(3, "photo_id", "det_seq")
    assert _plan(votes.composed(rows, Options())).count("Exchange hashpartitioning") == 3


def test_ends_of_crops_are_found_without_sorting(spark):
    parts = [(1, 420, 150, 390, 5, 1, 10, 60, 600), (1, 420, 150, 100, 5, 3, 2, 60, 120), (1, 420, 150, 100, 5, 2, 9, 60, 540), (1, 420, 150, 390, 5, 4, 12, 60, 720), (2, 420, 150, 9, 5, 1, 1, 60, 60)]
    cuts = boxes.field_cuts(spark.createDataFrame(parts, "crop_id long, plate_w int, plate_h int, x int, y int, comp_id int, w int, h int, area int"))
    assert "SortAggregate" not in _plan(cuts)
    got = {r.crop_id: (r.n_bars, r.digits_end, r.letter_start, r.letter_end, r.region_start) for r in cuts.collect()}
    assert got == {1: (4, 99, 103, 384, 408), 2: (0, None, None, None, None)}


def test_pooled_readings_are_made_in_the_tasks_that_number_lines(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_LINES", 500)
    got = catalog.QUERIES["pooled_readings"](spark, SF)
    n = fixtures.lines(spark, SF).count()
    assert got.rdd.getNumPartitions() == -(-n // 500) > 4 and "Union" not in _plan(got)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 18 * n and max(sizes) < 18 * 1500


def test_pooled_readings_are_those_of_fields_and_whole_plates(spark):
    tables = catalog.Tables(spark, SF)
    got, want = tables.pooled(), votes.pooled(tables.fields, tables.whole)
    assert got.dtypes == want.dtypes
    got, want = (df.groupBy(*df.columns).count() for df in (got, want))
    assert got.count() == want.count() > 1000 and not got.exceptAll(want).head(1)


_TEXTS = ["12345", "１２３４５", "①2345", "9071-ب-6", "ﬁ", "é", "ب", "ﺏ", "", None, "7"]


def _dealt(spark, dealt):
    rows = [(p, d, f, k, _TEXTS[(p + 3 * d + 5 * k + len(f)) % len(_TEXTS)], k / 8) for p in range(40) for d in (1, 2) for f in votes.FIELDS for k in range(1, 6)]
    return saved(spark.createDataFrame(rows, "photo_id long, det_seq int, field string, variant_no int, raw_text string, confidence double"), "readings", dealt)


def test_votes_of_readings_dealt_by_photo_stay_in_their_tasks(spark):
    rows = _dealt(spark, (3, "photo_id"))
    want, got = votes.composed(_dealt(spark, None), Options()), votes.composed(rows, Options(), "photo_id")
    # Only texts that Python decomposes leave their tasks and come back.
    assert _plan(got).count("Exchange") == 1 and "ArrowEvalPython" in _plan(got).split("Exchange", 1)[1]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 80
    whole = rows.withColumn("reading_seq", F.col("variant_no"))
    assert _plan(votes.whole_votes(whole, Options(), "photo_id")).count("Exchange") == 1
    assert {tuple(r) for r in votes.whole_votes(whole, Options(), "photo_id").collect()} == {tuple(r) for r in votes.whole_votes(whole, Options()).collect()} != set()


@pytest.mark.parametrize(("query", "most"), [("staged_calls", 0), ("staged_readings", 1), ("activity_log", 1), ("plate_report_rows", 0), ("compose_fields", 1), ("crowded_pairs", 0)])
def test_tables_dealt_by_photo_are_not_shuffled_again(spark, query, most):
    plan = _plan(catalog.QUERIES[query](spark, SF))
    # One for texts that Python decomposed; crowded photos' boxes are dealt by cell (gw and others).
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "gw#" not in line]
    assert len(shuffles) <= most, shuffles


def test_a_recogniser_s_tasks_are_not_saved(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    catalog.QUERIES["staged_calls"](spark, SF)
    new = set(os.listdir(folder)) - before
    assert not any("tasks" in name for name in new) and any(name.startswith("field-answers-") for name in new)


def test_pairs_of_photos_with_few_boxes_have_no_cells(spark):
    rows = [(p, k, 10 * (k % 3), 0, 10 * (k % 3) + 50, 40 + k % 2, 0.5) for p, n in ((1, 4), (2, 30), (3, 6), (4, 7)) for k in range(n)]
    df = spark.createDataFrame(rows, "photo_id long, det_seq int, x1 int, y1 int, x2 int, y2 int, confidence double")
    want = {tuple(r) for r in boxes.overlap_pairs(df, Options()).collect()}
    for limit in (0, 6, 100):
        got = [tuple(r) for r in crowded.overlap_pairs(df, Options(), limit).collect()]
        assert set(got) == want and len(got) == len(want) > 100
    near = tuple(at for at in crowded._AROUND if at >= (0, 0))
    assert len(near) == 5 and crowded._cells(df, 0.6, near).count() == 20 * len(rows)

"""Suppression in crowded photos against the list form and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plateworks.operators import boxes, crowded
from plateworks.options import Options

O = Options()
BOX = "photo_id long, det_seq int, x1 int, y1 int, x2 int, y2 int, confidence double"


def _random(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w, h = rng.randrange(-20, 150), rng.randrange(90), rng.choice([1, 7, 30, 31, 50, 51, 200]), rng.choice([1, 2, 20, 33, 120])
        rows.append((k % 3, k, x, y, x + w, y + h, rng.randrange(8) / 8))
    return rows


def _overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)


def _kept(rows, limit):
    out = []
    for r in sorted(rows, key=lambda r: (r[0], -r[6], r[1])):
        if all(k[0] != r[0] or _overlap(k, r) < limit for k in out):
            out.append(r)
    return {r[:2] for r in out}


@pytest.mark.parametrize(("limit", "rounds"), [(0.6, 4), (0.6, 0), (0.3, 2)])
def test_rounds_keep_what_one_pass_keeps(spark, limit, rounds):
    o, rows = Options(duplicate_iou=limit), _random(int(limit * 10), 400)
    df = spark.createDataFrame(rows, BOX)
    got = crowded.in_rounds(df, o, rounds)
    assert got.columns == df.columns and {(r.photo_id, r.det_seq) for r in got.collect()} == _kept(rows, limit)


@pytest.mark.parametrize("limit", [0.1, 0.6, 1.0])
def test_pairs_equal_all_pairs(spark, limit):
    o, df = Options(duplicate_iou=limit), spark.createDataFrame(_random(9, 240), BOX)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(crowded.overlap_pairs(df, o)) == rows(boxes.overlap_pairs(df, o))


def test_a_chain_and_equal_boxes(spark):
    chain = [(1, k, 20 * k, 0, 20 * k + 100, 50, 1 - k / 1000) for k in range(300)]  # each overlaps the next alone too much
    same = [(2, k, 5, 5, 45, 45, 0.5) for k in range(300)]
    rows = [*chain, *same, (3, 1, 0, 0, 9, 9, 0.5)]
    df = spark.createDataFrame(rows, BOX)
    got = {(r.photo_id, r.det_seq) for r in crowded.suppressed(df, O).collect()}
    assert got == _kept(rows, 0.6) and (2, 0) in got and len(got) == 150 + 1 + 1
    assert crowded.suppressed(df.limit(0), O).count() == 0 == crowded.in_rounds(df.limit(0), O).count()
    with pytest.raises(ValueError, match="overlap"):
        crowded.overlap_pairs(df, Options(duplicate_iou=0.0))


def test_rows_of_a_round_follow_the_boxes(spark):
    n = 20_000
    same = spark.range(n).selectExpr("1L AS photo_id", "cast(id as int) AS det_seq", "10 AS x1", "10 AS y1", "90 AS x2", "40 AS y2", "0.5D AS confidence").withColumn("rank", -F.col("confidence"))
    decided = crowded._round(same, O)
    assert decided.groupBy("kept").count().orderBy("kept").collect() == [(False, n - 1), (True, 1)]
    met = crowded._meeting(same.where("det_seq = 0"), same, O)
    assert met.count() == n - 1

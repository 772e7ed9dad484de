"""Files of vehicles: all or none, in pieces, under the names that a run gives them."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plateworks.operators import boxes
from plateworks.options import Options
from plateworks.plans import documents, reading
from plateworks.sources import files
from plateworks.sources.files import write_files

O = Options()


def _files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def _beside(folder):
    return sorted(p.name for p in folder.parent.iterdir())


def test_pieces_are_appended_in_order(spark, tmp_path):
    rows = [("a/x.txt", 2, "B\n"), ("b.bin", 1, None), ("a/x.txt", 1, "é\n"), ("a/y.txt", 1, "y"), ("a/x.txt", 10, "C"), (None, 1, "lost")]
    write_files(spark.createDataFrame(rows, "name string, k int, content string").repartition(4), str(tmp_path / "out"), ("k",))
    assert _files(tmp_path / "out") == {"a/x.txt": "é\nB\nC".encode(), "a/y.txt": b"y", "b.bin": b""} and _beside(tmp_path / "out") == ["out"]


def test_a_folder_is_replaced_only_if_that_is_asked_for(spark, tmp_path):
    write = lambda name, **more: write_files(spark.createDataFrame([(name, "1")], "name string, content string"), f"file://{tmp_path}/out", **more)
    write("a")
    with pytest.raises(Exception, match="is there already"):
        write("b")
    assert set(_files(tmp_path / "out")) == {"a"}
    write("c", overwrite=True)
    assert set(_files(tmp_path / "out")) == {"c"} and _beside(tmp_path / "out") == ["out"]


@pytest.mark.parametrize("how", ["raises", "exits"])
def test_nothing_is_seen_of_a_run_whose_task_fails(spark, tmp_path, how):
    @F.udf("string")
    def content(k):
        if k == 900:
            if how == "exits":
                os._exit(1)
            raise ValueError("no")
        return str(k)

    write_files(spark.createDataFrame([("old", "1")], "name string, content string"), str(tmp_path / "out"))
    rows = spark.range(1000).select(F.concat(F.lit("f"), F.col("id")).alias("name"), "id")
    late = spark.range(1000).repartition(4).sortWithinPartitions("id").select(F.concat(F.lit("f"), F.col("id")).alias("name"), content("id").alias("content"))
    with pytest.raises(Exception):  # noqa: B017
        late.write.format("named_files").option("path", str(tmp_path / "out")).mode("overwrite").save()
    assert _files(tmp_path / "out") == {"old": b"1"} and _beside(tmp_path / "out") == ["out"]
    write_files(rows.select("name", F.lit("x").alias("content")), str(tmp_path / "out"), overwrite=True)
    assert len(_files(tmp_path / "out")) == 1000


def test_no_rows_give_an_empty_folder(spark, tmp_path):
    write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path / "out"))
    assert _beside(tmp_path / "out") == ["out"] and _files(tmp_path / "out") == {}


def _run(spark):
    photos = spark.createDataFrame([(1, "car 1/x", 1, '/a/q".b.jpg'), (2, "car 1/x", 2, "/a/y.jpg"), (3, "car 1/x", 113, "/c/y.jpg"), (4, "8", 4, "/b/w.jpg")], "photo_id long, group_id string, position int, path string")
    read = spark.createDataFrame(
        [(1, 1, True, "7", "ب", "2", "7-ب-2", "7-ب-2", 0.75, 0.5), (1, 2, False, None, None, None, None, "unreadable", 0.0, 0.25), (3, 1, False, "?", "?", "3", "7-ب-2", "7-ب-2", 0.12345, 0.98765)],
        "photo_id long, det_index int, segmented boolean, digits string, letter string, region string, plate_text string, text string, score double, detector_confidence double",
    )
    framed = read.select("photo_id", "det_index", *(F.lit(k).alias(c) for k, c in enumerate(boxes.BOX)))
    agreed = spark.createDataFrame([("car 1/x", "7-ب-2", 2, 3), ("8", None, 0, 1)], "group_id string, plate string, agreeing long, n_images long")
    return photos, read, framed, agreed


def test_documents_logs_and_crops_of_vehicles(spark, tmp_path):
    photos, read, framed, agreed = _run(spark)
    rows = reading.report_rows(photos, read, framed)
    gone = spark.createDataFrame([], "photo_id long, group_id string, path string")
    log = documents.log_pieces(reading.activity_log(photos, read), reading.run_summary(agreed, gone))
    crops = framed.withColumn("crop", F.when(F.col("det_index") == 1, F.encode(F.lit("pixels"), "utf-8")))
    pieces = documents.document_pieces(photos, rows, agreed).unionByName(log)
    binary = pieces.withColumn("content", F.col("content").cast("binary")).unionByName(documents.crop_pieces(crops, photos))
    write_files(binary, str(tmp_path / "out"), documents.ORDER)
    got = _files(tmp_path / "out")
    assert set(got) == {f"{c}/{f}" for c in ("car+1%2Fx", "8") for f in ("plate.json", "activity.log")} | {'car+1%2Fx/01_q".b_plate1.jpg', "car+1%2Fx/113_y_plate1.jpg"}
    want = {r.group_id: r.document for r in reading.report_json(photos, rows, agreed).collect()}
    assert got["car+1%2Fx/plate.json"].decode() == want["car 1/x"] and got["8/plate.json"].decode() == want["8"]
    assert [len(i["plates"]) for i in json.loads(got["car+1%2Fx/plate.json"])["images"]] == [2, 0, 1]
    assert got["8/activity.log"].decode() == "Detecting plates in w.jpg...\n  no plate found in w.jpg\n\nPlate: unreadable\n"
    assert got["car+1%2Fx/activity.log"].decode().endswith("  plate 1: 7-ب-2 [whole plate, detector 0.99]\n\nPlate: 7-ب-2\nAgreement: 2/3 images\n")
    assert got["car+1%2Fx/113_y_plate1.jpg"] == b"pixels"


def test_a_document_of_many_photos_has_no_list(spark):
    n = 50_000
    photos = spark.range(n).selectExpr("id AS photo_id", "'v' AS group_id", "cast(id + 1 as int) AS position", "concat('/p/', id, '.jpg') AS path")
    _, read, framed, _ = _run(spark)
    agreed = spark.createDataFrame([("v", None, 0, n)], "group_id string, plate string, agreeing long, n_images long")
    pieces = documents.document_pieces(photos, reading.report_rows(photos, read, framed), agreed)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and pieces.count() == 2 * n + 3 + 2
    assert pieces.agg(F.max(F.length("content"))).first()[0] < 400


def test_files_are_read_by_name_in_tasks(spark, tmp_path, monkeypatch):
    rows = [(k, f"v+{k % 3}/{k}.txt", f"é{k}" * 50) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, name string, content string")
    write_files(df.select("name", "content"), str(tmp_path / "out"))
    monkeypatch.setattr(files, "READ_BYTES", 500)
    got = files.read_files(df.select("k", "name"), f"file://{tmp_path}/out", "text")
    assert got.columns == ["k", "text"] and {(r.k, r.text) for r in got.collect()} == {(k, t) for k, _, t in rows}
    assert files.read_files(df.where("k < 0").select("k", "name"), str(tmp_path / "out"), "text").count() == 0
    with pytest.raises(Exception, match="v\\+0/99.txt"):
        files.read_files(spark.createDataFrame([(1, "v+0/99.txt")], "k long, name string"), str(tmp_path / "out"), "text").collect()


def test_a_vehicle_has_one_folder_while_files_are_written(tmp_path):
    out = files.Writer(str(tmp_path / "out"), False)
    seen = []
    batch = pa.RecordBatch.from_arrays([pa.array(["a/x", "b/x"]), pa.array([b"1", b"2"])], ["name", "content"])

    def batches():
        yield batch
        seen.extend(p for p in tmp_path.rglob("*") if p.is_dir() and p.name in "ab")

    out.write(batches())
    assert not seen and {p.name for p in tmp_path.rglob("*") if p.is_file()} == {"x"}
    out.commit([])
    assert _files(tmp_path / "out") == {"a/x": b"1", "b/x": b"2"} and _beside(tmp_path / "out") == ["out"]

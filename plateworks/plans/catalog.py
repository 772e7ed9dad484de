"""Registered plate queries and their DuckDB counterparts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repair_digits
from ..operators import boxes as b
from ..operators import crowded, stages
from ..operators import votes as v
from ..options import Options
from ..sources import fixtures as x
from ..sources.files import read_files, write_files
from ..sources.saved import folder, large, saved
from ..streaming import plates as running
from . import documents as d
from . import reading as r
from . import staged as st
from .sql import QUERIES_SQL as SQL  # noqa: F401


class Tables:
    """The plate views of one folder, and the steps that several queries share."""

    def __init__(self, spark, sf_dir: str):
        self.o, self.source = Options.of(spark), (spark, sf_dir)
        self.photos, self.listing, self.levels = (f(spark, sf_dir) for f in (x.photos, x.listing, x.levels))
        self.n_tasks, self.dealt = x.tasks(spark, sf_dir), None
        self.lines = x.lines(spark, sf_dir, self.n_tasks)
        self._views()

    def _views(self) -> None:
        self.raw, self.readings, self.whole, self.fields, self.components, self.crops = (
            f(*self.source, self.lines) for f in (x.raw_boxes, x.readings, x.whole_readings, x.field_readings, x.components, x.crop_components)
        )

    def cuts(self) -> DataFrame:
        return b.field_cuts(self.components)

    def frames(self) -> DataFrame:
        return b.ocr_frames(self.cuts(), self.o)

    def answered(self, frames: DataFrame | None = None) -> DataFrame:
        return stages.run(b.ocr_tasks(frames or self.frames()), stages.backend("echo"), stages.READING)

    def answered_fields(self) -> DataFrame:
        """Answers to the tasks of fields; those of whole plates are not asked for."""
        return self.answered(self.frames().where("field <> 'whole'")).where("error is null").withColumnRenamed("crop_id", "photo_id").withColumn("det_seq", F.lit(1))

    def padded(self) -> DataFrame:
        return b.padded(b.confident(self.raw, self.o), self.photos, self.o)

    def detections(self) -> DataFrame:
        return r.detections(self.raw, self.photos, self.o)

    def numbered(self) -> Tables:
        """The same views over saved lines with their vehicles, and saved photos, which are then numbered once for all of them and dealt by photo."""
        if not self.dealt:
            self.dealt = (self.n_tasks, "photo_id")
            self.lines = saved(x.owned(*self.source, self.lines), "lines", (self.n_tasks, "l_orderkey"))
            self.photos = saved(self.photos, "photos", self.dealt)
            self._views()
        return self

    def pooled(self) -> DataFrame:
        """Readings of all renderings in one bag, as v.pooled puts fields and whole plates together."""
        return x.pooled_readings(*self.source, self.lines)

    def asked(self, view) -> r.Readings:
        """A view's readings of the detections asked for: lines are chosen before readings are made of them."""

        def read(keys: DataFrame) -> DataFrame:
            chosen = keys.withColumnRenamed("photo_id", "l_orderkey")
            return view(*self.source, self.lines.join(large(chosen), ["l_orderkey", "det_seq"], "left_semi"))

        return read

    def routed(self) -> DataFrame:
        self.numbered()
        return r.routed_votes(self.detections(), b.field_cuts(self.crops, v.DETECTION), self.asked(x.field_readings), self.asked(x.whole_readings), self.o, self.dealt)

    def staged(self, read=None) -> st.Staged:
        """Two-phase recognition; the recogniser's answers are the tables of readings, unless one is given."""
        self.numbered()
        known = [read, read] if read else [st.replayed(self.fields, None), st.replayed(None, self.whole)]
        return st.staged(self.detections(), b.field_cuts(self.crops, v.DETECTION), known[0], self.o, known[1], self.dealt, read is None)

    def echoed(self) -> st.Staged:
        return self.staged(lambda tasks: stages.run(tasks, stages.backend("echo", seed=3), stages.READING))

    def read(self) -> DataFrame:
        return r.plate_readings(self.routed())

    def results(self) -> DataFrame:
        read = self.read()
        return r.photo_results(self.photos, r.photo_best(read), read)

    def votes(self) -> DataFrame:
        return r.group_votes(self.routed(), self.photos)

    def plates(self) -> DataFrame:
        return r.group_plate(self.votes(), self.photos)

    def agreed(self) -> DataFrame:
        return r.agreement(self.plates(), self.results())

    def kept(self) -> Tables:
        """The same tables with detections and all votes saved, for queries that need them several times."""
        found = saved(self.numbered().detections(), "found", self.dealt)
        self.detections = lambda: found
        votes = saved(self.routed(), "votes", self.dealt)
        self.routed = lambda: votes
        return self

    def written(self, pieces: DataFrame, file: str, name: str) -> DataFrame:
        """group_id and the text of each vehicle's file, written to a folder and read back."""
        path = folder(self.photos.sparkSession, "vehicles")
        write_files(pieces, path, d.ORDER)
        vehicles = self.photos.where("group_id is not null").select("group_id").repartition(self.n_tasks, "group_id").distinct()
        return read_files(vehicles.select("group_id", d.file_name(F.lit(file))), path, name)

    def streamed(self, batches: int = 3) -> DataFrame:
        """Plates and agreement of a stream that gets the photos in batches."""
        rows = running.photo_rows(self.photos, self.routed(), r.photo_best(self.read()))
        return running.in_batches(saved(rows, "photos"), folder(self.photos.sparkSession, "stream"), batches)

    def report(self) -> DataFrame:
        return r.report_rows(self.photos, self.read(), self.detections())


def _votes_json(votes: DataFrame) -> DataFrame:
    """The map as text, its weights with six places, so that other engines can show the same."""
    # The product decides a tie of the seventh place, as it does where a cast to decimal multiplies by 10^6.
    shown = F.transform_values("votes", lambda _, w: (F.round(w * F.lit(1e6)).cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(20,6)").cast("string"))
    return r.votes_map(votes).select("group_id", F.to_json(shown).alias("votes"))


def _parsed(t: Tables) -> DataFrame:
    return v.parsed(t.readings).select("photo_id", "reading_seq", "digits", "letter", "region", "is_temporary", "plate_text")


_BY_NAME = {
    "photo_manifest": lambda t: r.manifest(t.photos),
    "missing_photos": lambda t: r.missing(t.photos, t.listing),
    "confident_boxes": lambda t: b.confident(t.raw, t.o).select("photo_id", "det_seq", "confidence"),
    "padded_boxes": lambda t: t.padded(),
    "overlap_pairs": lambda t: b.overlap_pairs(t.padded(), t.o),
    "dedup_boxes": lambda t: b.deduplicated(t.padded(), t.o),
    "crowded_pairs": lambda t: crowded.overlap_pairs(t.numbered().padded(), t.o, limit=6),
    "crowded_boxes": lambda t: crowded.suppressed(t.padded(), t.o, limit=4),
    "detection_index": lambda t: t.detections().select("photo_id", "det_seq", "det_index"),
    "crop_manifest": lambda t: r.crop_manifest(t.detections(), t.photos),
    "separator_bars": lambda t: b.separator_bars(t.components).select("crop_id", "comp_id", "x", "w"),
    "field_cuts": lambda t: t.cuts(),
    "ink_extent": lambda t: b.ink_extent(t.components),
    "plate_body": lambda t: b.plate_body(t.components),
    "ocr_frame_size": lambda t: t.frames(),
    "ocr_tasks_fields": lambda t: b.field_tasks(t.frames()),
    "ocr_tasks_whole": lambda t: b.whole_tasks(t.frames()),
    "otsu_threshold": lambda t: b.otsu_threshold(t.levels),
    "clean_readings": lambda t: v.clean(t.fields).select("photo_id", "det_seq", "field", "variant_no", "raw_text"),
    "alphabet_violations": lambda t: v.alphabet_violations(t.pooled()),
    "normalize_text": lambda t: v.parsed(t.readings).select("photo_id", "reading_seq", "normal_text"),
    "repair_digits": lambda t: t.fields.where("field <> 'letter'").select("photo_id", "det_seq", "field", "variant_no", repair_digits(F.col("raw_text")).alias("repaired")),
    "parse_plate": _parsed,
    "valid_plates": lambda t: _parsed(t).select("photo_id", "reading_seq", F.col("plate_text").isNotNull().alias("valid")),
    "parse_rejects": lambda t: v.rejects(t.readings),
    "pooled_readings": lambda t: t.pooled(),
    "vote_digits": lambda t: v.field_winners(t.numbered().fields, t.o, "digits", "photo_id"),
    "vote_region": lambda t: v.field_winners(t.numbered().fields, t.o, "region", "photo_id"),
    "vote_letter": lambda t: v.field_winners(t.numbered().fields, t.o, "letter", "photo_id"),
    "vote_whole": lambda t: v.whole_votes(t.numbered().whole, t.o, "photo_id").select("photo_id", "det_seq", "text", "weight"),
    "compose_fields": lambda t: v.composed(t.numbered().fields, t.o, "photo_id"),
    "plate_readings": lambda t: t.read(),
    "photo_best": lambda t: r.photo_best(t.read()),
    "photo_results": lambda t: t.kept().results(),
    "group_votes": lambda t: t.votes().select("group_id", "text", "weight"),
    "group_plate": lambda t: t.plates(),
    "running_plates": lambda t: t.kept().streamed(),
    "agreement": lambda t: t.kept().agreed(),
    "run_summary": lambda t: r.run_summary(t.kept().agreed(), r.missing(t.photos, t.listing)),
    "activity_log": lambda t: (lambda k: r.activity_log(k.photos, k.read()))(t.numbered()),
    "plate_report_rows": lambda t: t.kept().report(),
    "plate_report_json": lambda t: (lambda k: r.report_json(k.photos, k.report(), k.agreed()))(t.kept()),
    "written_documents": lambda t: (lambda k: k.written(d.document_pieces(k.photos, k.report(), k.agreed()), d.DOCUMENT, "document"))(t.kept()),
    "written_logs": lambda t: (lambda k: k.written(d.log_pieces(r.activity_log(k.photos, k.read()), r.run_summary(k.agreed(), r.missing(k.photos, k.listing))), d.LOG, "log"))(t.kept()),
    "preview_pick": lambda t: r.preview_pick(t.kept().results()),
    "votes_map": lambda t: _votes_json(t.votes()),
    "recogniser_stage": lambda t: t.answered().where("error is null").drop("error"),
    "recogniser_errors": lambda t: t.answered().where("error is not null").groupBy("error").agg(F.count("*").alias("n")),
    "recogniser_plates": lambda t: v.composed(t.answered_fields(), t.o).drop("det_seq"),
    "staged_readings": lambda t: t.staged().readings(),
    "staged_calls": lambda t: t.staged().calls(),
    "staged_quarantine": lambda t: t.echoed().quarantine(),
    "staged_recogniser": lambda t: t.echoed().readings(),
    "detector_stage": lambda t: r.detections(stages.run(t.photos.select("photo_id", "img_w", "img_h"), stages.centre_detector, stages.BOX).where("error is null").drop("img_w", "img_h"), t.photos, t.o),
}

QUERIES = {name: lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir)) for name, f in _BY_NAME.items()}

"""Recognition in two phases: fields first, whole plates only where fields gave none.

A recogniser is a function of a table of tasks, which returns the same columns
with reading_seq, raw_text, confidence and error: a backend run by
:mod:`plateworks.operators.stages`, or a table of answers joined to them. It is
the costly part, so the answers of each phase are saved, and the tasks of the
second are made by an anti-join with the plates that the first gave.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boxes as b
from ..operators import votes as v
from ..options import Options
from ..sources.saved import Dealt, large, saved
from . import reading as r

KEY = v.DETECTION
#: Readings of one rendering that keep their order among those of the next.
_READINGS = 1 << 20
Recogniser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Staged:
    """Tasks and answers of both phases, and the votes that follow."""

    found: DataFrame
    field_tasks: DataFrame
    whole_tasks: DataFrame
    answers: DataFrame
    routed: DataFrame

    def readings(self) -> DataFrame:
        return r.plate_readings(self.routed)

    def calls(self) -> DataFrame:
        """photo_id, det_index, field_calls, whole_calls, calls: how often the recogniser is asked about each detection."""
        n = lambda tasks, name: tasks.groupBy(*KEY).agg(F.count("*").alias(name))
        rows = self.found.select(*KEY, "det_index").join(large(n(self.field_tasks, "field_calls")), [*KEY], "left").join(large(n(self.whole_tasks, "whole_calls")), [*KEY], "left")
        counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("field_calls", "whole_calls")}
        rows = rows.withColumns(counts)
        return rows.select("photo_id", "det_index", "field_calls", "whole_calls", (F.col("field_calls") + F.col("whole_calls")).alias("calls"))

    def quarantine(self) -> DataFrame:
        """Tasks that failed, with their errors."""
        return self.answers.where("error is not null").drop("reading_seq", "raw_text", "confidence")


def field_texts(answers: DataFrame) -> DataFrame:
    """Readings of fields; variant_no orders them by rendering, then as the recogniser gave them."""
    order = ((F.col("variant_no") - 1) * _READINGS + F.col("reading_seq")).cast("int")
    return answers.where("error is null and field <> 'whole'").select(*KEY, "field", order.alias("variant_no"), "raw_text", "confidence")


def whole_texts(answers: DataFrame) -> DataFrame:
    """Readings of whole plates, in order of rendering, restricted ones first, then as given."""
    call = 2 * (F.col("variant_no") - 1) + (F.col("alphabet") == "any").cast("int")
    return answers.where("error is null and field = 'whole'").select(*KEY, (call * _READINGS + F.col("reading_seq")).cast("int").alias("reading_seq"), "raw_text", "confidence")


def staged(found: DataFrame, cuts: DataFrame, fields: Recogniser, o: Options, whole: Recogniser | None = None, dealt: Dealt | None = None, stays: bool = False) -> Staged:
    """Votes of all detections, with as few calls as they need.

    ``found``: photo_id, det_seq, det_index, confidence of detections. ``cuts``:
    the field cuts of their crops; a detection without any is read whole.
    ``whole`` answers the second phase, if it is not the same recogniser. ``dealt``
    says how both tables are dealt by photo, if they are, and ``stays`` that
    answers stay in the tasks of theirs, as those of a join do. A recogniser's
    tasks are made of saved cuts and detections when they are wanted.
    """
    found = saved(found, "found", dealt)
    own = saved(cuts.join(large(found.select(*KEY)), [*KEY], "left_semi"), "cuts", dealt)
    key, kept = (dealt[1], dealt) if dealt and stays else (None, None)
    # Whole plates of these crops may never be asked for.
    first = b.field_calls(b.field_frames(own, KEY), KEY)
    answered = saved(fields(first), "field-answers", kept)
    read = r.by_field(found, own, lambda _: field_texts(answered), o, dealt, key)  # answers are those of cut plates alone
    unread = read.where("not done").select(*KEY, F.lit("whole").alias("field"))
    second = b.whole_calls(unread, KEY)
    more = saved((whole or fields)(second), "whole-answers", kept)
    answers = answered.unionByName(more)
    routed = r.with_whole(read, lambda _: whole_texts(more), o, key)
    return Staged(found, first, second, answers, routed)


def replayed(fields: DataFrame | None, whole: DataFrame | None) -> Recogniser:
    """A recogniser whose answers are there already, as tables of readings of fields and of whole plates; a phase that has one alone needs no other."""
    by_field = F.when(F.col("field") == "letter", "letters").otherwise("digits")
    shown = ((F.col("reading_seq") + 1) / 2).cast("int")
    tables = []
    if fields is not None:
        tables.append(fields.select(*KEY, "field", "variant_no", by_field.alias("alphabet"), "raw_text", "confidence"))
    if whole is not None:
        tables.append(whole.select(*KEY, F.lit("whole").alias("field"), shown.alias("variant_no"), F.when(F.col("restricted"), "both").otherwise("any").alias("alphabet"), "raw_text", "confidence"))
    known = reduce(DataFrame.unionByName, tables)

    def read(tasks: DataFrame) -> DataFrame:
        return tasks.join(large(known), [*KEY, "field", "variant_no", "alphabet"]).withColumns({"reading_seq": F.lit(1), "error": F.lit(None).cast("string")})

    return read

"""Plates of vehicles whose photos arrive over time: the votes of a run as state that merges.

The state of a vehicle is, for each text, the sum of its votes, the place where it
was first seen and the number of photos that it is best in, and the winner so far.
A sum only grows and a first place only moves up, so a text that a batch does not
touch cannot become the winner in it: the winner is found among the last one and
the texts of the batch, whatever the vehicle has. Its first texts are one value,
which a batch reads and writes at once; further ones are a map that is kept in the
state store, not in memory, and asked for the texts of the batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.saved import large

VOTE = "array<struct<det_index:int,first_seq:bigint,text:string,weight:double>>"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Places that sums are rounded to before they are compared, as those of a whole run are.
PLACES = 12
#: What is known of a text: its votes, where it was first seen, and in how many photos it is best.
_TEXT = {"text": "string", "weight": "double", "position": "int", "det_index": "int", "first_seq": "bigint", "n": "bigint"}
_UNSEEN = (None, None, None, None, 0)
#: Texts of a vehicle that are kept as one value; further ones are a map's.
FEW = 64


def photo_rows(photos: DataFrame, routed: DataFrame, best: DataFrame) -> DataFrame:
    """group_id, position, plate_text, votes: a row for each photo, with the votes of its detections."""
    vote = F.struct(F.col("det_index").cast("int").alias("det_index"), F.col("first_seq").cast("long").alias("first_seq"), "text", (F.col("weight") * F.col("confidence")).alias("weight"))
    votes = routed.where("text is not null").groupBy("photo_id").agg(F.collect_list(vote).alias("votes"))
    rows = photos.select("photo_id", "group_id", "position").join(large(best.select("photo_id", "plate_text")), "photo_id", "left").join(large(votes), "photo_id", "left")
    return rows.select("group_id", "position", "plate_text", F.coalesce("votes", F.array().cast(VOTE)).alias("votes"))


class Vehicle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", f"plate string, n_images bigint, has_more boolean, {', '.join(f'{c} array<{t}>' for c, t in _TEXT.items())}")
        self.more = handle.getMapState("more", "text string", ", ".join(f"{c} {t}" for c, t in _TEXT.items() if c != "text"))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[str, tuple] = {}
        best, n = Counter(), 0
        for photo in rows:
            n += 1
            if photo.plate_text is not None:
                best[photo.plate_text] += 1
            for v in photo.votes:
                new[v["text"]] = _merged(new.get(v["text"]), (v["weight"], photo.position, v["det_index"], v["first_seq"]))
        # Each look into the state is a message to the JVM: one for the first texts, whatever their number.
        winner, seen, has_more, *columns = self.few.get() or (None, 0, False, *([] for _ in _TEXT))
        few = {t: tuple(rest) for t, *rest in zip(*columns, strict=True)}

        def known(text: str) -> tuple | None:
            if text in few or not has_more or not self.more.containsKey((text,)):
                return few.get(text)
            return tuple(self.more.getValue((text,)))

        ranked, changed = {}, {}
        if winner is not None:
            ranked[winner] = known(winner)
        for text in new.keys() | best.keys():
            *vote, count = ranked.get(text) or known(text) or _UNSEEN
            vote = tuple(vote) if vote[0] is not None else None
            vote = _merged(vote, new[text]) if text in new else vote or _UNSEEN[:-1]
            changed[text] = (*vote, count + best[text])
            if vote[0] is not None:
                ranked[text] = changed[text]
        for text, now in sorted(changed.items()):
            if text in few or len(few) < FEW:
                few[text] = now
            else:
                self.more.updateValue((text,), now)
                has_more = True
        winner = min(ranked, key=lambda t: (-round(ranked[t][0], PLACES), *ranked[t][1:-1]), default=None)
        columns = [[*c] for c in zip(*((t, *rest) for t, rest in few.items()), strict=True)] or [[] for _ in _TEXT]
        self.few.update((winner, seen + n, has_more, *columns))
        agreeing = 0 if winner is None else ranked[winner][-1]
        score = None if winner is None else round(ranked[winner][0], PLACES)
        yield Row(group_id=key[0], plate=winner, score=score, agreeing=agreeing, n_images=seen + n)

    def close(self) -> None:
        pass


def _merged(old: tuple | None, new: tuple) -> tuple:
    """Sum of the weights, and the lesser place."""
    return new if old is None else (old[0] + new[0], *min(tuple(old[1:]), tuple(new[1:])))


def running_plates(rows: DataFrame) -> DataFrame:
    """group_id, plate, score, agreeing, n_images of each vehicle that a batch has photos of, over all its photos so far."""
    spark = rows.sparkSession
    spark.conf.set(_STORE, _ROCKS)  # the store that has maps
    kind = dict(rows.dtypes)["group_id"]
    out = f"group_id {kind}, plate string, score double, agreeing bigint, n_images bigint"
    return rows.groupBy("group_id").transformWithState(Vehicle(), out, "Update", "None")


def latest(updates: DataFrame) -> DataFrame:
    """The last row of each vehicle: the one that has seen most photos."""
    columns = [c for c in updates.columns if c != "group_id"]
    return updates.groupBy("group_id").agg(F.max_by(F.struct(*columns), "n_images").alias("u")).select("group_id", "u.*")


def in_batches(rows: DataFrame, folder: str, batches: int) -> DataFrame:
    """The last rows of a stream that gets the photos in so many batches, dealt by their place in the run."""
    spark = rows.sparkSession
    dealt = rows.withColumn("_batch", F.pmod(F.col("position"), F.lit(batches)))
    append = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}")
    for k in range(batches):
        # As many files as tasks wrote: the stream, which goes on from its state, takes all that came since its last turn as one batch.
        dealt.where(F.col("_batch") == k).drop("_batch").write.mode("append").parquet(f"{folder}/photos")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/photos")
        query = running_plates(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(append).trigger(availableNow=True).start()
        query.awaitTermination()
    return latest(spark.read.parquet(f"{folder}/updates").drop("batch"))

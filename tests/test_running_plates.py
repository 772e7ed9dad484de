"""Votes of a run as merging state: photos in batches give what the whole run gives."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from plateworks.plans import reading
from plateworks.streaming import plates

ROUTED = "photo_id long, det_index int, text string, weight double, confidence double, first_seq int"


def _run(spark):
    """Vehicle 1: a tie that an earlier photo of the last batch settles; 2: a late favourite; 3: nothing read; 4: one photo."""
    votes = [
        (11, 1, "B", 0.5, 0.5, 1), (12, 1, "A", 0.5, 0.5, 1), (10, 2, "A", 0.25, 0.5, 3), (10, 1, "B", 0.25, 0.5, 9), (13, 1, "C", 0.1, 0.1, 0),
        (20, 1, "A", 1.0, 1.0, 0), (21, 1, "B", 0.5, 1.0, 0), (22, 1, "B", 0.75, 1.0, 2), (22, 1, "A", 0.125, 1.0, 1), (23, 1, None, None, 0.5, 0), (40, 1, "A", 0.3, 0.1, 0), (40, 2, "A", 0.3, 0.2, 0),
    ]
    photos = [(p, p // 10, p % 10 + 1) for p in (10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 40)]
    photos = spark.createDataFrame(photos, "photo_id long, group_id long, position int")
    routed = spark.createDataFrame(votes, ROUTED)
    best = routed.where("text is not null").groupBy("photo_id").agg(F.max_by("text", F.col("weight") * F.col("confidence")).alias("plate_text"))
    return photos, routed, best


def test_three_batches_give_the_plates_of_the_run(spark, tmp_path):
    photos, routed, best = _run(spark)
    whole = reading.group_plate(reading.group_votes(routed, photos), photos)
    results = photos.join(best, "photo_id", "left")
    agreed = reading.agreement(whole, results)
    want = {r.group_id: (r.plate, r.score, r.agreeing, r.n_images) for r in whole.join(agreed.drop("plate"), "group_id").collect()}
    rows = plates.photo_rows(photos, routed, best)
    got = {r.group_id: (r.plate, r.score, r.agreeing, r.n_images) for r in plates.in_batches(rows, str(tmp_path), 3).collect()}
    assert got == want and got[1][0] == "B" and got[2][0] == "B" and got[3] == (None, None, 0, 2)
    updates = spark.read.parquet(str(tmp_path / "updates"))
    assert updates.where("group_id = 1").count() == 3 and updates.where("group_id = 4").count() == 1


def test_a_stream_goes_on_from_its_state(spark, tmp_path):
    photos, routed, best = _run(spark)
    rows = plates.photo_rows(photos, routed, best)
    plates.in_batches(rows.where("group_id = 2 and position < 3"), str(tmp_path), 2)
    got = plates.in_batches(rows.where("group_id = 2 and position >= 3"), str(tmp_path), 2).collect()
    assert [(r.plate, r.n_images) for r in got] == [("B", 4)]


class _State:
    """Counts the messages of a vehicle's state."""

    def __init__(self):
        self.value, self.map, self.asked = None, {}, 0

    def getValueState(self, *_):
        return _Of(self, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getMapState(self, *_):
        return _Of(self, containsKey=lambda k: k in self.map, getValue=self.map.get, updateValue=self.map.__setitem__)


class _Of:
    def __init__(self, state, **calls):
        def counted(f):
            def call(*args):
                state.asked += 1
                return f(*args)

            return call

        self.__dict__ |= {name: counted(f) for name, f in calls.items()}


def _photo(position, best, *votes):
    return Row(position=position, plate_text=best, votes=[{"det_index": 1, "first_seq": k, "text": t, "weight": w} for k, (t, w) in enumerate(votes)])


def test_a_batch_asks_the_state_twice_whatever_the_texts(monkeypatch):
    state, vehicle = _State(), plates.Vehicle()
    vehicle.init(state)
    photos = [_photo(k + 1, f"T{k % 7}", *((f"T{(k + j) % 20}", 0.25) for j in range(5))) for k in range(30)]
    for k in range(0, 30, 10):
        last = list(vehicle.handleInputRows((1,), iter(photos[k : k + 10]), None))
    assert state.asked == 6 and not state.map
    small, other = _State(), plates.Vehicle()
    monkeypatch.setattr(plates, "FEW", 3)
    other.init(small)
    for k in range(0, 30, 10):
        got = list(other.handleInputRows((1,), iter(photos[k : k + 10]), None))
    assert got == last and got[0].n_images == 30 and len(small.value[3]) == 3 and len(small.map) == 17


def test_texts_beyond_the_first_are_kept_in_the_store(spark, tmp_path):
    """Seventy texts before the one that wins in the last batch, which is the map's."""
    rows = [(1, p, f"W{p}", [(1, k, f"W{p}" if p == 3 else f"T{p}-{k}", 0.5) for k in range(70)]) for p in (1, 2)] + [(1, 3, "T2-69", [(1, 0, "T2-69", 0.25)])]
    df = spark.createDataFrame(rows, f"group_id long, position int, plate_text string, votes {plates.VOTE}")
    got = [tuple(r) for r in plates.in_batches(df, str(tmp_path), 3).collect()]
    assert got == [(1, "T2-69", 0.75, 1, 3)]

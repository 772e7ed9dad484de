"""Vector codes against plain Python, and where members stay."""

import hashlib
import math
import random

import pytest

from plateworks.llm import codes

VEC = "vec_id long, embedding array<float>, label int, row int, part string, entry string"


def _expected(vectors, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    first = [least[i] for i in sorted(least)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for p in range(parts):
                x = v[p * width : (p + 1) * width]
                gaps = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in books[p]]
                row.append((min(gaps), gaps.index(min(gaps))))
            out.append(row)
        return out

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for e in range(len(first)):
                own = [v[p * width : (p + 1) * width] for (_, v, _), row in zip(kept, now, strict=True) if row[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    now = assign()
    errors = [sum(g for g, _ in row) for row in now]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    by_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted((-1 if i is None else i, "".join(f"{e:02x}" for _, e in row), err, by_label[lab], digest) for (i, _, lab), row, err in zip(kept, now, errors, strict=True))


def _vectors(n, dim, rng):
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i * 3 % 101 + i // 101 * 101, [round(8 * (c + rng.gauss(0, 0.2))) / 8 for c in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (4, 5, 4), (3, 200, 1)])
def test_codes_equal_plain_python(spark, parts, entries, rounds, monkeypatch):
    monkeypatch.setattr(codes, "MEMBERS", 100)  # several owners an entry
    vectors = _vectors(150, 32, random.Random(parts))
    vectors += [vectors[0], (vectors[1][0], vectors[2][1], 9), (None, vectors[3][1], 1), (-5, [0.5] * 30, None), (7000, None, 1), (7001, [0.1, None], 1), (7002, [float("nan")] * 32, 1), (7003, [float("inf")] * 32, None), (-9, [], 1)]
    df = spark.createDataFrame([(*v, 0, "p", "e") for v in vectors], VEC)
    got = codes.compress(df, parts, entries, rounds).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == _expected(vectors, parts, entries, rounds)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("members_")]


def test_owners_add_up_without_a_shuffle_and_only_movers_migrate(spark, monkeypatch):
    monkeypatch.setattr(codes, "MEMBERS", 200)
    vectors = _vectors(400, 16, random.Random(8))
    rows = codes.save(codes._rows(spark.createDataFrame([(*v, 0, "", "") for v in vectors], VEC), "vec_id", "embedding", "label"), "vectors")
    members = codes.Members(rows, 400, 4, 4)
    books = codes._first_codebooks(rows, 4, 4, 8)
    members.placed(rows, books)
    owners = members.table().groupBy(*codes.OWNER).count()
    assert "Exchange" not in owners._jdf.queryExecution().executedPlan().toString()
    before = {(r.row, r.pos): r.entry for r in members.table().collect()}
    files = set(members.table().inputFiles())
    books = members.updated(books)
    moved = members.compared(books).where("moved").count()
    members.migrated(books)
    after = {(r.row, r.pos): r.entry for r in members.table().collect()}
    assert len(after) == 1600 == members.table().count() and 0 < moved < 1600
    assert sum(before[k] != after[k] for k in before) == moved and not files & set(members.table().inputFiles())
    members.close()


def test_large_components_are_refused_and_no_rows_give_none(spark):
    with pytest.raises(ValueError, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e7] * 16, 1, 0, "", "")], VEC)).collect()
    assert codes.compress(spark.createDataFrame([], VEC)).collect() == []
    assert codes.compress(spark.createDataFrame([(None, [1.0], 1, 0, "", ""), (1, None, 1, 0, "", "")], VEC)).collect() == []

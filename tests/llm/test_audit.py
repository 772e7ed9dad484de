"""Filter interaction audit against plain Python, and the layout of its integers."""

import re
from collections import Counter
from itertools import permutations

import pytest

from plateworks.llm import audit

DOC = "doc_id long, text string, source string, part string, code int, good string"
PLAIN = " ".join(f"word{i}" for i in range(60))
TEXTS = [(1, PLAIN, "a"), (2, PLAIN, "b"), (2, PLAIN, "b"), (3, None, "a"), (4, "", None), (5, "SHOUT " * 60, ""), (6, "a $ sign", "a"), (7, " \t\n", "b"), (None, PLAIN, "a"), (8, PLAIN + " #" * 9, "a"), (9, "é" * 200 + "ABCDEFGHIJ", None), (9, "x y", "b"), (10, " ".join(f"LONG{i % 50}" for i in range(90000)), "a")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (10, 1, 1), (77, 1, 1)]


def _expected(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                left = kept
        for k in [k for k in out if k[0] == part]:
            out[k][6] = shapley[out[k][6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_plain_python(spark):
    docs = spark.createDataFrame([(i, t, s, "p", 3, "g") for i, t, s in TEXTS], DOC)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = audit.filter_audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) == 3 * 600 and got == _expected(TEXTS, LABELS)


def test_audit_of_no_rows(spark):
    none, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(none, labels).collect() == []
    docs = spark.createDataFrame([(1, PLAIN, "a", "", 0, "")], DOC)
    assert {(r.good_lost, r.toxic_lost) for r in audit.filter_audit(docs, labels).collect()} == {(0, 0)}


@pytest.mark.parametrize("n", [1, 255, 256, 65535, 65536, 10**12])
def test_full_fields_do_not_run_over(n):
    layout = audit.Packed("AB", 1, n)
    found = layout.unpacked(layout.bytes_of(n * layout.integers()[0b111]))
    assert found["removed"].tolist() == [n, 0, n, 0] == found["lost_0"].tolist()
    assert found["kept"].tolist() == [0] * 4 and found["redundant"].tolist() == [0, n, 0, n] and found["shapley"].tolist() == [n] * 4


def test_many_parts_are_added_up_in_turns(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_HELD", 50)
    rows = spark.range(3000).selectExpr("cast(id % 700 as string) AS part", "cast(id % 2 as int) AS code")
    monkeypatch.setattr(audit, "SALTS", 3)
    got = {r.part: r.removed for r in audit.interactions(rows, "A", (), 3000).collect()}
    assert got == {str(p): sum(x % 2 for x in range(3000) if x % 700 == p) for p in range(700)}

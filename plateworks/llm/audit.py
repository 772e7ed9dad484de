"""Filter interaction audit by wide packed counters.

Each document fails some of the filters; the set of these is its mask. In an
order of the filters, the first that fails a document removes it. Every mask maps
to one big integer with a field for each step of each order (600 for five
filters), which holds 1 where the step removes the document, and a further field
that is always 1; documents with a mark (good, toxic) have the same fields again,
once for each mark. Tasks add up the integers of their rows for each part, sums
of tasks meet by part and salt and then by part, and a part's sum is unpacked
once. A field counts rows, so with as many bits as the number of all rows has,
none can run over into the next.

What else is asked follows from these fields: a filter fails as many rows as it
removes when it comes first, and is the only one to fail as many as it removes
when it comes last; what a step leaves is what came in less what was removed up
to it.

Null texts are empty. Rows without an id are audited; they are never a copy of a
smaller id, nor marked. Rows of one id and text are no copies of each other. A
document has a mark if any of its label rows says so. Null parts are the empty
string. An empty table gives no rows. Columns other than those named are not
read, so that their names may clash with any used here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import few, save, with_class

#: Parts that a task adds up at a time, and shares that the sums of a part's tasks are first dealt into.
PARTS_HELD, SALTS = 2000, 64
BLANKS = r"[\x20\x09-\x0D]+"


class Packed:
    """Layout of the integers: a field of whole bytes for each step of each order, and one for the row itself."""

    def __init__(self, filters: str, marks: int, rows: int):
        self.filters, self.marks = filters, marks
        self.orders = list(permutations(range(len(filters))))
        self.size = -(-max(rows, 1).bit_length() // 8)
        self.fields = factorial(len(filters)) * len(filters) + 1

    def integers(self) -> list[int]:
        """The integer of each code: a mask of failed filters, and above it one bit for each mark."""
        n, bits = len(self.filters), 8 * self.size
        out = []
        for code in range(1 << (n + self.marks)):
            one = 1 << bits * (self.fields - 1)
            for k, order in enumerate(self.orders):
                step = next((s for s, f in enumerate(order) if code >> f & 1), None)
                if step is not None:
                    one |= 1 << bits * (k * n + step)
            out.append(one | sum(one << bits * self.fields * (m + 1) for m in range(self.marks) if code >> (n + m) & 1))
        return out

    def bytes_of(self, total: int) -> bytes:
        return total.to_bytes(self.size * self.fields * (1 + self.marks), "little")

    def unpacked(self, packed: bytes) -> dict[str, np.ndarray]:
        """Counts of each step of each order, from a sum."""
        n = len(self.filters)
        digits = np.frombuffer(packed, np.uint8).reshape(1 + self.marks, self.fields, self.size).astype(np.int64)
        count = (digits << 8 * np.arange(self.size)).sum(axis=2)
        removed = count[:, :-1].reshape(1 + self.marks, len(self.orders), n)
        own, who = removed[0], np.array(self.orders)
        fails, alone, shapley = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(shapley, who, own)
        fails[who[:, 0]], alone[who[:, -1]] = own[:, 0], own[:, -1]
        out = {"kept": count[0, -1] - own.cumsum(axis=1), "removed": own, "redundant": fails[who] - own, "unique_fails": alone[who]}
        out |= {f"lost_{m}": removed[1 + m] for m in range(self.marks)}
        return {k: v.ravel() for k, v in (out | {"shapley": shapley[who]}).items()}


def interactions(rows: DataFrame, filters: str, marks: tuple[str, ...], n_rows: int) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost of each mark, shapley.

    ``rows``: part and code, whose bits say which filters fail a row, in the
    order of the letters of ``filters``, and above them which marks it has.
    ``n_rows`` is their number, or more.
    """
    layout = Packed(filters, len(marks), n_rows)
    binary, held, salts = "part string, salt int, packed binary", PARTS_HELD, SALTS

    def batch_of(sums: dict[str, int], salt: int) -> pa.RecordBatch:
        packed = pa.array([layout.bytes_of(x) for x in sums.values()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([salt] * len(sums), pa.int32()), packed], names=["part", "salt", "packed"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, integers, sums = TaskContext.get().partitionId() % salts, layout.integers(), {}
        for batch in batches:
            for (part, code), n in Counter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                sums[part] = sums.get(part, 0) + n * integers[code]
            if len(sums) > held:
                yield batch_of(sums, salt)
                sums = {}
        yield batch_of(sums, salt)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        """Sums of equal parts, which follow one another."""
        part, total = None, 0
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != part:
                    if part is not None:
                        yield part, total
                    part, total = name, 0
                total += int.from_bytes(packed, "little")
        if part is not None:
            yield part, total

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, total in added(batches):
            yield batch_of({part: total}, 0)

    names = ["".join(filters[f] for f in order) for order in layout.orders]
    counts = ["kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(filters)
        for part, total in added(batches):
            found = layout.unpacked(layout.bytes_of(total))
            step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names)))
            cols = [pa.array([part] * (n * len(names))), pa.array(np.repeat(np.array(names, object), n), pa.string()), step, *(pa.array(v) for v in found.values())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "filter_order", "step", *counts])

    sums = rows.select("part", "code").mapInArrow(tally, binary)
    sums = sums.repartition("part", "salt").sortWithinPartitions("part").select("part", "packed").mapInArrow(merge, binary)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts)
    return sums.repartition("part").sortWithinPartitions("part").select("part", "packed").mapInArrow(report, schema)


def text_failures(text: Column) -> list[Column]:
    """Which of the filters A to D fail a text; they read nothing but the text."""
    words = F.array_remove(F.split(text, BLANKS), "")
    long = lambda c: c.cast("long")
    n = long(F.size(words))
    return [n < 50, 100 * long(F.size(F.array_distinct(words))) < 65 * n, 100 * long(F.regexp_count(text, F.lit("[A-Z]"))) > 5 * long(F.length(text)), text.rlike(r"[#$%&*|]")]


def _marked(rows: DataFrame, marks: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the marks of their id, false where it has none; rows without an id are not dealt out for it."""
    joined = rows.where("id is not null").join(few(marks), "id", "left").unionByName(rows.where("id is null"), allowMissingColumns=True)
    return joined.withColumns({m: F.coalesce(m, F.lit(False)) for m in names})


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Five filters in all their orders, for each part: under 50 words, few distinct words, many capitals, marks of code, copies."""
    text = F.coalesce(text_col, F.lit(""))
    bits = [F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))]
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = save(slim.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    first = flags.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = with_class(flags, save(first, "copies"), "digest")
    says = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    marks = labels.where(F.col(id_col).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("id")).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(m) for m, c in says.items()))
    rows = _marked(found.select("id", "part", "mask", "first"), save(marks, "marks"), ["good", "toxic"])
    copy = F.when(F.col("first") < F.col("id"), 16).otherwise(0)
    code = F.col("mask") + copy + F.col("good").cast("int") * 32 + F.col("toxic").cast("int") * 64
    return interactions(rows.select("part", code.alias("code")), "ABCDE", ("good", "toxic"), flags.count())


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN smallest < doc_id THEN 16 ELSE 0 END AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
i AS (SELECT range AS k FROM range(5)),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (
  SELECT array_to_string(list_transform(ks, lambda k: chr(CAST(65 + k AS INT))), '') AS filter_order, CAST(p.k + 1 AS INT) AS step, CAST(1 << ks[p.k + 1] AS BIGINT) AS own,
    CAST(coalesce(list_sum(list_transform(ks[1:p.k], lambda k: 1 << k)), 0) AS BIGINT) AS before FROM o, i p),
c AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (good AND mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (toxic AND mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""

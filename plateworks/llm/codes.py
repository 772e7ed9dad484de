"""Product codes of vectors, trained by member-resident rounds of Lloyd's algorithm.

Vectors of integers are cut into equal parts, and each part position has a
codebook, whose entries begin as the parts of the vectors with the smallest ids.
A part is a member of the entry nearest to it. Members live in a table that is
bucketed by owner, which is (position, entry, salt); the salt deals the members of
a popular entry over many owners. In a round, owners add up the members that are
resident with them, without a shuffle, and one small row for each owner gives the
new codebooks, which have a fixed size. Owners then compare their members with
these: those that keep their entry are written to the same bucket, and only those
that change go through a shuffle to their new owners.

Vectors that are null or hold a null or non-finite component take no part.
Vectors are filled up with zeros to the same number of whole parts. Rows with one
id are coded apart; the one with the least vector stands for the id in the first
codebooks. Rows without an id are coded and stand in no first codebook; if no row
has an id, or the table is empty, the result is empty. Fewer ids than entries make
smaller codebooks. Equal labels, as text, add up their errors, and so do nulls.
Components whose squared distances may not fit in 64 bits raise an error. Columns
other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, drop, save, shared_dir, with_class

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Members of an owner that the number of salts aims at, and of a bucket of the members' table; the most buckets.
MEMBERS, BUCKETS = 1 << 16, 4096
#: Parts that a step compares with a codebook.
STEP = 4096
OWNER = ("pos", "entry", "salt")
_MEMBER = "pos int, entry int, salt int, row long, part array<long>"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row, id, label (text, for equality), v."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))
    v = F.transform("x", lambda c: F.floor(SCALE * c).cast("long"))
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("x")).where(finite(F.col("x")))
    return slim.select(F.monotonically_increasing_id().alias("row"), "id", "label", v.alias("v"))


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's entry, the lower one on a tie, and its squared distance."""
    entry, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), STEP):
        gap = ((parts[at : at + STEP, None, :] - codebook[None]) ** 2).sum(axis=2)
        entry[at : at + STEP] = gap.argmin(axis=1)
        error[at : at + STEP] = gap.min(axis=1)
    return entry, error


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, width)


def _batch(pos: int | np.ndarray, entry: np.ndarray, salt: np.ndarray, row: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(np.broadcast_to(x, len(row)).astype(np.int32)) for x in (pos, entry, salt)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(row), _lists(parts)], names=["pos", "entry", "salt", "row", "part"])


class Members:
    """The members' table of a training, one state after another."""

    def __init__(self, rows: DataFrame, n_rows: int, parts: int, width: int):
        self.spark, self.parts, self.width = rows.sparkSession, parts, width
        self.salts = -(-n_rows // MEMBERS)
        self.buckets = min(BUCKETS, -(-n_rows * parts // MEMBERS))
        self.name: str | None = None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def dealt(self, members: DataFrame) -> DataFrame:
        return members.repartition(self.buckets, *OWNER)

    def written(self, members: DataFrame) -> None:
        """The next state, in buckets of owners; the last one goes."""
        name = f"members_{uuid.uuid4().hex}"
        members.write.bucketBy(self.buckets, *OWNER).option("path", shared_dir(self.spark, "members")).saveAsTable(name)
        self.close()
        self.name = name

    def close(self) -> None:
        if self.name:
            old = self.table()
            drop(old)
            self.spark.sql(f"DROP TABLE {self.name}")
            self.name = None

    def placed(self, rows: DataFrame, codebooks: np.ndarray) -> None:
        """All parts move to their first owners."""
        parts, width, salts = self.parts, self.width, self.salts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, v = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.diff(v.offsets.to_numpy())
                m = np.zeros((len(row), parts * width), np.int64)
                m[np.repeat(np.arange(len(row)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
                for p in range(parts):
                    own = m[:, p * width : (p + 1) * width]
                    yield _batch(p, nearest(own, codebooks[p])[0], row % salts, row, own)

        self.written(self.dealt(rows.select("row", "v").mapInArrow(run, _MEMBER)))

    def updated(self, codebooks: np.ndarray) -> np.ndarray:
        """Codebooks of the members' means; at most one row for each entry reaches the driver."""
        total = [F.sum(F.get("part", F.lit(k))).alias(f"s{k}") for k in range(self.width)]
        # The table's buckets hold each owner's members together: no exchange here, and one of a row for each owner next.
        owners = self.table().groupBy(*OWNER).agg(F.count("*").alias("n"), *total)
        merged = owners.groupBy("pos", "entry").agg(*(F.sum(c).alias(c) for c in owners.columns[3:]))
        out = codebooks.copy()
        for r in merged.toLocalIterator():
            out[r.pos, r.entry] = [r[f"s{k}"] // r.n for k in range(self.width)]
        return out

    def compared(self, codebooks: np.ndarray, error: bool = False) -> DataFrame:
        """Members with their entries by these codebooks, and whether that is a new one (or their squared distance)."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pos, old = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                parts = _matrix(batch.column(4), width)
                entry, gap = old.astype(np.int64), np.zeros(len(old), np.int64)
                for p in np.unique(pos):
                    at = pos == p
                    entry[at], gap[at] = nearest(parts[at], codebooks[p])
                if error:
                    yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), pa.array(entry.astype(np.int32)), pa.array(gap)], names=["row", "pos", "entry", "error"])
                else:
                    whole = _batch(pos, entry, batch.column(2).to_numpy(), batch.column(3).to_numpy(), parts)
                    yield whole.append_column("moved", pa.array(entry != old))

        columns = self.table().select(*OWNER, "row", "part")
        return columns.mapInArrow(run, "row long, pos int, entry int, error long" if error else f"{_MEMBER}, moved boolean")

    def migrated(self, codebooks: np.ndarray) -> None:
        """Members that change their entry go to its owners; all others stay."""
        found = self.compared(codebooks).persist(StorageLevel.DISK_ONLY)
        stay, move = found.where("not moved").drop("moved"), found.where("moved").drop("moved")
        self.written(stay.unionByName(self.dealt(move)))
        found.unpersist()


def _first_codebooks(rows: DataFrame, parts: int, width: int, entries: int) -> np.ndarray:
    """[position, entry, place] of the vectors of the smallest ids; at most ``entries`` rows reach the driver."""
    first = rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    m = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        m[k, : len(r.v)] = r.v
    return np.ascontiguousarray(m.reshape(len(first), parts, width).transpose(1, 0, 2))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256: one row for each vector that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    rows = save(_rows(bounded(vectors), id_col, vector_col, label_col), "vectors")
    size = F.max(F.size("v"))
    n_rows, longest, largest = rows.agg(F.count("*"), size, F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    width = max(1, -(-(longest or 0) // parts))
    if (largest or 0.0) and (2 * largest) ** 2 * parts * width >= 2.0**63:
        raise ValueError("components are too large for squared distances of 64 bits")
    codebooks = _first_codebooks(rows, parts, width, entries) if n_rows else np.zeros((parts, 0, width), np.int64)
    if not codebooks.shape[1]:
        return rows.sparkSession.createDataFrame([], f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string")
    members = Members(rows, n_rows, parts, width)
    members.placed(rows, codebooks)
    for k in range(rounds):
        if k:
            members.migrated(codebooks)
        codebooks = members.updated(codebooks)
    # Eight entries of a byte each in a number; those of further parts in further numbers.
    byte = "shiftleft(cast(entry AS long), 56 - 8 * (pos % 8))"
    numbers = [F.bit_or(F.expr(f"CASE WHEN pos div 8 = {k} THEN {byte} ELSE 0L END")).alias(f"c{k}") for k in range(-(-parts // 8))]
    each = members.compared(codebooks, error=True).groupBy("row").agg(*numbers, F.sum("error").alias("error"))
    code = F.concat(*(F.lower(F.lpad(F.hex(f"c{k}"), 16, "0")) for k in range(len(numbers))))
    coded = each.join(rows.select("row", "id", "label"), "row").select("id", "label", F.substring(code, 1, 2 * parts).alias("code"), "error")
    coded = save(coded, "codes")
    members.close()
    drop(rows)
    by_label = save(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    out = with_class(coded, by_label, "label")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_GAP = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"


def _sql() -> str:
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT r, pos, v[pos * (len(v) // 16) + 1 : (pos + 1) * (len(v) // 16)] AS x FROM k, (SELECT range AS pos FROM range(16)))",
        "s AS (SELECT vec_id, min(v) AS v FROM k WHERE vec_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 64)",
        "b0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, v[pos * (len(v) // 16) + 1 : (pos + 1) * (len(v) // 16)] AS c FROM s, (SELECT range AS pos FROM range(16)))",
    ]
    for k in range(3):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, pos, any_value(x) AS x, arg_min(e, (gap, e)) AS e, min(gap) AS gap FROM (SELECT r, p.pos, x, e, {_GAP} AS gap FROM p JOIN b{k} USING (pos)) GROUP BY 1, 2)")
        if k < 2:
            steps.append(f"m{k} AS (SELECT pos, e, list(y ORDER BY i) AS c FROM (SELECT pos, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM a{k}, (SELECT range AS i FROM range(1, 4097)) WHERE i <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT pos, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (pos, e))")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b2)")
    steps.append("d AS (SELECT r, string_agg(lpad(format('{:x}', e), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a2 GROUP BY 1)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM d JOIN k USING (r), h"


OP12_SQL = _sql()

"""Exact top-k inner products over integer vectors, by norm-sorted blocks.

Vectors are ordered by descending length and cut into blocks. A rotation from
the singular vectors of the whole table (the eigenvectors of its Gram matrix,
summed in a distributed way) moves most of the weight to the front, so a partial
inner product and the product of the two residual lengths bound the rest
(Cauchy-Schwarz). Every query first meets the longest vectors, which gives its
threshold; queries are then dealt into blocks by how long a vector must be to
matter to them. A block of queries reads the blocks of candidates that are long
enough in descending length, a span of them to a task, with thresholds that rise
as it goes, and stops at the first block that is too short for all of them;
only pairs whose bounds reach a threshold are scored exactly.

Vectors that are null, empty or hold a null or non-finite component, and rows
without an id, take no part. Shorter vectors count as filled up with zeros. Each
row is a candidate, repeated ones too, for all queries of other ids; the rows of
one id that ask make one query, whose best scores are those of any of them. Ties
go to the smaller id. Components whose products may not fit in 64 bits raise an
error. Empty tables give an empty result. Columns other than id and vector are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, drop, few, save

K, SCALE, QUERY_STEP = 5, 256, 50
_NO_ID = np.iinfo(np.int64).max
#: Vectors of a block of candidates and of queries; both bound what a task holds.
BLOCK, QUERY_BLOCK = 2048, 1024
#: Blocks of candidates that follow one another in a partition, and partitions that one task reads for a block of queries.
RUN, SPAN = 16, 4
#: Candidates scored together, and shares of the dimensions after which a bound is taken.
CHUNK, STAGES = 256, (0.25, 0.5)


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (floor(SCALE * x) of each component), norm2, and row, which tells rows of one id apart."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    whole = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(SCALE * c).cast("long"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.withColumns({"norm2": norm2, "row": F.monotonically_increasing_id()})


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat, bounds = col.flatten().to_numpy(), col.offsets.to_numpy()
    n = np.diff(bounds)
    out = np.zeros((len(col), dim), np.int64)
    out[np.repeat(np.arange(len(col)), n), np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], n)] = flat
    return out


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table; dim * dim numbers leave each task."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(total.ravel())], names=["at", "g"])

    g = vectors.select("v").mapInArrow(gram, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
    full = np.zeros(dim * dim)
    full[g.column(0).to_numpy()] = g.column(1).to_numpy()
    _, basis = np.linalg.eigh(full.reshape(dim, dim))
    return basis[:, ::-1].copy()


def _packed(rows: DataFrame, size: int, columns: str, row_of) -> DataFrame:
    """One row for ``size`` rows that follow one another in a partition; numbers rise with partition and place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= size:
                yield row_of(part << 32 | k, held.slice(0, size).combine_chunks())
                held, k = held.slice(size), k + 1
        if held is not None and len(held):
            yield row_of(part << 32 | k, held.combine_chunks())

    return rows.mapInArrow(pack, columns)


def _blocks(vectors: DataFrame, size: int, dim: int) -> DataFrame:
    """Rows in partitions of descending length, packed: block, longest (largest norm2), ids, vs."""

    def row(block: int, t: pa.Table) -> pa.RecordBatch:
        m = _matrix(t.column(1).chunk(0), dim)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([t.column(2)[0].as_py()]), pa.array([t.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<i8").tobytes()], pa.binary())], names=["block", "longest", "ids", "vs"])

    return _packed(vectors.select("id", "v", "norm2"), size, "block long, longest double, ids binary, vs binary", row)


def _query_blocks(started: DataFrame, dim: int) -> DataFrame:
    """Rows in order of need, packed: q_block, need (the least), ids, vs, floor."""

    def row(block: int, t: pa.Table) -> pa.RecordBatch:
        m = _matrix(t.column(1).chunk(0), dim)
        values = [t.column(0).to_numpy().astype("<i8").tobytes(), m.astype("<i8").tobytes(), t.column(2).to_numpy().tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([t.column(3)[0].as_py()]), *(pa.array([x], pa.binary()) for x in values)], names=["q_block", "need", "ids", "vs", "floor"])

    return _packed(started.select("id", "v", "floor", "need"), QUERY_BLOCK, "q_block long, need double, ids binary, vs binary, floor binary", row)


class Search:
    """Best scores of a block of queries so far, and the bounded scan of a block of candidates."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, basis: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.v, self.k, self.floor = ids, v, k, floor
        self.rotated = v @ basis
        self.norm = np.sqrt((self.rotated**2).sum(axis=1))
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.near = np.full((len(ids), k), _NO_ID)
        self.count = np.zeros(len(ids), np.int64)

    def threshold(self) -> np.ndarray:
        own = np.where(self.count >= self.k, self.score[:, -1].astype(np.float64), -np.inf)
        return np.maximum(own, self.floor)

    def scan(self, ids: np.ndarray, v: np.ndarray, basis: np.ndarray) -> None:
        rotated = v @ basis
        dim = v.shape[1]
        cuts = sorted({max(1, int(s * dim)) for s in STAGES})
        for at in range(0, len(ids), CHUNK):
            c, part = ids[at : at + CHUNK], rotated[at : at + CHUNK]
            norm = np.sqrt((part**2).sum(axis=1))
            slack = 1e-9 * self.norm * norm.max() + 1e-6
            limit = self.threshold() - slack
            run = np.flatnonzero(self.norm * norm.max() >= limit)
            if not len(run):
                continue
            left, partial = None, None
            for cut in cuts:
                rest_q = np.sqrt((self.rotated[run, cut:] ** 2).sum(axis=1))
                rest_c = np.sqrt((part[:, cut:] ** 2).sum(axis=1))
                partial = self.rotated[run, :cut] @ part[:, :cut].T
                left = partial + rest_q[:, None] * rest_c >= limit[run, None]
                alive = left.any(axis=1)
                run, left = run[alive], left[alive]
                if not len(run):
                    break
            if not len(run):
                continue
            q, j = np.nonzero(left & (c[None, :] != self.ids[run, None]))
            if len(q):
                self._add(run[q], c[j], np.einsum("ij,ij->i", self.v[run[q]], v[at + j]))

    def _add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(q)
        have = np.repeat(rows, self.k)
        q = np.concatenate((q, have))
        score = np.concatenate((score, self.score[rows].ravel()))
        ids = np.concatenate((ids, self.near[rows].ravel()))
        real = ids != _NO_ID
        by = np.lexsort((ids, -score, ~real, q))
        q, score, ids, real = q[by], score[by], ids[by], real[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = (rank < self.k) & real
        self.score[rows], self.near[rows] = np.iinfo(np.int64).min, _NO_ID
        self.score[q[top], rank[top]], self.near[q[top], rank[top]] = score[top], ids[top]
        self.count[rows] = np.bincount(q[top], minlength=rows.max() + 1)[rows]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = self.near != _NO_ID
        return np.repeat(self.ids, some.sum(axis=1)), self.near[some], self.score[some]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with other rows."""
    rows = save(quantised(bounded(vectors), id_col, vector_col), "vectors")
    asked = save(quantised(queries, id_col, vector_col), "asked")
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))
    total, dim, high = rows.agg(F.count("*"), F.max(F.size("v")), largest).first()
    n_asked, asked_dim, asked_high = asked.agg(F.count("*"), F.max(F.size("v")), largest).first()
    schema = "query_id long, vec_id long, score long"
    if not total or not n_asked:
        return rows.sparkSession.createDataFrame([], "query_id long, `rank` int, vec_id long, score long")
    dim = max(dim, asked_dim)
    if high * asked_high * dim >= 2.0**63:
        raise ValueError("components are too large for inner products of 64 bits")
    basis = rows.sparkSession.sparkContext.broadcast(_rotation(rows, dim))
    parts = max(1, -(-total // (RUN * BLOCK)))
    # Ids and rows break ties of length, so that copies of one vector, or of one row, spread over partitions.
    ordered = rows.repartitionByRange(parts, F.desc("norm2"), "id", "row").sortWithinPartitions(F.desc("norm2"), "id", "row")
    blocks = save(_blocks(ordered, BLOCK, dim), "blocks")
    # One block, of BLOCK vectors at most, whatever the size of the table.
    longest = blocks.orderBy("block").limit(1).toArrow().to_pylist()[0]
    seed = rows.sparkSession.sparkContext.broadcast((longest["ids"], longest["vs"]))

    def unpack(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(vs, "<i8").reshape(-1, dim)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(at, QUERY_BLOCK)
                ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
                s = Search(ids, v, basis.value, k, np.full(len(ids), -np.inf))
                s.scan(*unpack(*seed.value), basis.value)
                floor = s.threshold()
                with np.errstate(invalid="ignore", divide="ignore"):
                    need = np.where(np.isfinite(floor) & (s.norm > 0) & (floor > 0), (floor - 1e-6) / s.norm * (1 - 1e-9), 0.0)
                best = [(s.near[i][s.near[i] != _NO_ID].tolist(), s.score[i][s.near[i] != _NO_ID].tolist()) for i in range(len(ids))]
                cols = [batch.column(0), batch.column(1), pa.array(floor), pa.array(np.maximum(need, 0) ** 2 * (1 - 1e-9)), pa.array([b[0] for b in best], pa.list_(pa.int64())), pa.array([b[1] for b in best], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "floor", "need", "near", "score"])

    started = save(asked.select("id", "v").mapInArrow(first, "id long, v array<long>, floor double, need double, near array<long>, score array<long>"), "started")
    found = started.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip(F.col("near").alias("vec_id"), F.col("score").alias("score"))))
    dealt = started.repartitionByRange(max(1, -(-n_asked // (RUN * QUERY_BLOCK))), "need", "id").sortWithinPartitions("need", "id")
    asking = save(_query_blocks(dealt, dim), "queries")

    # Numbers of blocks are matched on lengths first; vectors join only where a bound lets them.
    meta = blocks.where(F.col("block") != longest["block"]).select("block", "longest")
    span = F.floor(F.shiftright("block", 32) / SPAN).alias("span")
    pairs = save(asking.select("q_block", "need").join(few(meta), F.col("longest") >= F.col("need")).select("q_block", span, "block"), "pairs")
    turns = pairs.select("q_block", "span").distinct().join(asking, "q_block").select("q_block", "span", F.lit(-1).cast("long").alias("block"), F.lit(0.0).alias("longest"), "ids", "vs", "floor")
    met = pairs.join(blocks, "block").select("q_block", "span", "block", "longest", "ids", "vs", F.lit(None).cast("binary").alias("floor"))
    # A turn begins with its queries; blocks of candidates follow in descending length.
    order = ["q_block", "span", "block"]
    turn = turns.unionByName(met).repartition("q_block", "span").sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, done = None, False

        def answer() -> Iterator[pa.RecordBatch]:
            if s is not None:
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in s.rows()], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                block, long, ids, vs, floor = (batch.column(j)[i].as_py() for j in range(5))
                if block < 0:
                    yield from answer()
                    s, done = Search(*unpack(ids, vs), basis.value, k, np.frombuffer(floor)), False
                elif not done:
                    done = bool((s.norm * np.sqrt(long) * (1 + 1e-9) + 1e-6 < s.threshold()).all())
                    if not done:
                        s.scan(*unpack(ids, vs), basis.value)
        yield from answer()

    found = found.unionByName(turn.select("block", "longest", "ids", "vs", "floor").mapInArrow(scan, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    drop(rows)
    return out


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

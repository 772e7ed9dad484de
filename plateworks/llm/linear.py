"""Hashed n-gram features and logistic regression with FTRL-proximal updates.

Features of a text: hashes of word n-grams (letters and marks apart, A-Z
lower-cased), optionally skip-grams, and a mark for a word that repeats the one
before. A feature's value is 1 + log(count), and a text's values have length 1.
Training follows the regularised leader, each coordinate at its own rate, with
L1 and L2 terms; only non-zero weights are kept, and scoring is a sparse dot
product with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Text, kinds_words, mix, ngrams, slices
from .shared import bounded, fold

_U = np.uint64


@dataclass(frozen=True)
class Options:
    """``shapes``: an n-gram's steps from word to word; () is a single word, (1,) a pair, (2,) a pair with one word between.

    With ``head``, the first so many bytes of longer words are features too, so
    that forms of one word share what they teach. Values of n-grams of several
    words are ``pair`` times those of words. ``sample`` bounds the labelled rows
    that training reads and ``held`` the features (8 bytes each) that it holds
    of them. Features of fewer than ``min_rows`` rows do not learn.
    """

    shapes: tuple[tuple[int, ...], ...]
    head: int = 0
    bits: int = 20
    pair: float = 1.0
    sample: int = 10_000
    held: int = 12_000_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    min_rows: int = 1


def features(col: pa.Array, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all rows one after another, and each row's bounds."""
    words = kinds_words(Text(col))
    h, rows = words.hashes(), words.rows()
    found = []
    if o.head:
        # Words no longer than a head count as words alone.
        long = np.flatnonzero(words.end - words.start > o.head)
        found.append((rows[long], (mix(words.hashes(o.head)[long] + _U(len(o.shapes) + 1)) >> _U(64 - o.bits)) << _U(1)))
    for salt, shape in enumerate(o.shapes, 1):
        g, r = ngrams(h, rows, shape, salt) if shape else (h, rows)
        found.append((r, (mix(g + _U(salt)) >> _U(64 - o.bits)) << _U(1) | _U(bool(shape))))
    again = np.flatnonzero((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) if len(h) else np.zeros(0, np.int64)
    found.append((rows[again], np.zeros(len(again), np.uint64)))
    key = np.concatenate([(r.astype(np.uint64) << _U(40)) | g for r, g in found])
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    value = (1 + np.log(count)) * np.where(key & _U(1), o.pair, 1.0)
    bounds = np.searchsorted(key, np.arange(len(col) + 1, dtype=np.uint64) << _U(40))
    norm = np.sqrt(np.maximum(1, np.diff(np.concatenate(([0.0], np.cumsum(value * value)))[bounds])))
    return ((key & _U((1 << 40) - 1)) >> _U(1)).astype(np.int64), value / np.repeat(norm, np.diff(bounds)), bounds


class Leader:
    """FTRL-proximal state; the last coordinate is the bias, which is not regularised."""

    def __init__(self, o: Options):
        self.o = o
        self.z = np.zeros((1 << o.bits) + 1)
        self.n = np.zeros((1 << o.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        o, z = self.o, self.z[at]
        l1, l2 = (np.where(at == 1 << o.bits, 0, x) for x in (o.l1, o.l2))
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((o.beta + np.sqrt(self.n[at])) / o.alpha + l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.o.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str, o: Options, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-zero weights (feature, weight) learned from at most ``o.sample`` labelled rows.

    The rows are those whose ids have the smallest hashes; in that order each is
    held that still fits into ``o.held`` features, and a longer one is passed over.
    So the sample is the same at each run; both numbers bound what the training
    task reads and holds.
    Null ids and labels are left out; the largest label counts if an id has
    several. Without labelled rows there are no weights.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(o.sample)
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("rank"), "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, x, bounds = features(batch.column(2), o)
            at, x = at.astype("<i4"), x.astype("<f4")
            spans = list(zip(bounds[:-1], bounds[1:], strict=True))
            cols = [batch.column(0), batch.column(1), pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rank", "y", "at", "x"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One array a batch rather than one a row: large arrays go back to the system when they are done with.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: list[tuple[int, int, int, int]] = []
        rows = np.zeros(1 << o.bits, np.int32)
        room = o.held
        for batch in batches:
            at, x = (Text(batch.column(c)) for c in (2, 3))
            spans = at.bounds // 4
            fit = []
            for k, size in enumerate(np.diff(spans).tolist()):
                if size <= room:
                    room -= size
                    fit.append(k)
            if not fit:
                continue
            cuts = np.concatenate(([0], np.cumsum(np.diff(spans)[fit]))).tolist()
            y = batch.column(1).to_pylist()
            seen += [(len(held), a, b, y[k]) for a, b, k in zip(cuts[:-1], cuts[1:], fit, strict=True)]
            whole = [t.data.view(kind) for t, kind in ((at, "<i4"), (x, "<f4"))]
            held.append(tuple(np.concatenate([w[spans[k] : spans[k + 1]] for k in fit]) for w in whole))
            rows += np.bincount(held[-1][0], minlength=len(rows)).astype(np.int32)
        often = rows >= o.min_rows
        leader = Leader(o)
        order = np.random.default_rng(1)
        for _ in range(o.epochs):
            for k in order.permutation(len(seen)):
                i, a, b, y = seen[k]
                at, x = held[i][0][a:b], held[i][1][a:b]
                keep = often[at]
                leader.learn(np.append(at[keep], np.int32(1 << o.bits)), np.append(x[keep], np.float32(1)), y)
        w = leader.weights(np.arange((1 << o.bits) + 1))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(w[kept], pa.float64())], names=["feature", "weight"])

    extracted = rows.mapInArrow(extract, "rank long, y int, at binary, x binary")
    return extracted.repartition(1).sortWithinPartitions("rank", "at").mapInArrow(lead, "feature int, weight double")


def score(docs: DataFrame, weights: DataFrame, o: Options, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in ``keep``, and score (0 to 1) of every whole text; null and empty texts get the bias alone.

    The non-zero weights, at most ``2 ** bits``, are broadcast in order of
    their features; each task spreads them out once.
    """
    learned = weights.toArrow().sort_by("feature")
    shared = docs.sparkSession.sparkContext.broadcast((learned.column(0).to_numpy(), learned.column(1).to_numpy().astype(np.float32)))
    slim = bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << o.bits) + 1, np.float32)
        w[shared.value[0]] = shared.value[1]
        for batch in slices(batches, "_text"):
            at, x, bounds = features(batch.column(1), o)
            sums = np.concatenate(([0.0], np.cumsum(w[at] * x)))[bounds]
            p = 1 / (1 + np.exp(-np.clip(np.diff(sums) + w[-1], -35, 35)))
            cols = [batch.column(0), *(batch.column(k) for k in range(2, batch.num_columns)), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *keep, "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "score double"])
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, label: str, o: Options, parts: int, held: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted: trained on the labels of the other folds, scored over all documents."""
    weights = train(docs, labels.where(fold(id_col, parts) != held), label, o, id_col, text_col)
    s = score(docs, weights, o, id_col, text_col)
    return s.select(id_col, F.coalesce(fold(id_col, parts) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

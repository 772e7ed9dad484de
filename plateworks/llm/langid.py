"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased, every run of characters that are not letters becomes one
blank, and each character is predicted from the three before it. A language's
model is a sorted array of hashes for each n-gram order, with the discounted
probability of each n-gram and the back-off weight of each context. The
language with the lowest cross-entropy a character wins. A text is rejected if
it has no letter, or if its cross-entropy exceeds a limit that is set, for each
language, from documents that the models were not fitted on.

Any number of languages may be learned; their models are a table in the shared
folder. Those that fit ``PASS_BYTES`` are held together by a task, and texts are
scored in as many passes as that takes, one for some dozen languages.

Null texts and texts without letters are ``und`` with score 0 and rejected.
Repeated rows get one row each; an empty table gives none; with nothing to learn
from, every text is ``und``. Columns other than id, text and lang are not read,
and lang and id only to choose what is learned from.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import mix, slices
from .shared import bounded, fold, few, save

_U = np.uint64
ORDER = 4
PARTS, HELD, CALIBRATION = 5, 0, 1
#: Documents a language that counts are taken from, and that limits are set by.
FIT_DOCS, CALIBRATION_DOCS = 1500, 300
#: Bytes of models that one pass holds, unless a single model is larger.
PASS_BYTES = 96 << 20
UNKNOWN = "und"
_BLANK = 32
_LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)


@dataclass
class Model:
    """grams[k] and contexts[k] belong to order k + 1; an entry is (sorted hashes, values)."""

    lang: str
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    symbols: int
    mean: float = 0.0
    spread: float = 1.0


def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all rows (each after ORDER - 1 blanks), bounds of rows, and their letters.

    A row without letters is empty.
    """
    lower = [t.lower() if t else "" for t in col.to_pylist()]
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[points]
    row = np.repeat(np.arange(len(lower)), size)
    points = np.where(is_letter, points, _BLANK).astype(np.uint32)
    count = np.bincount(row[is_letter], minlength=len(lower))
    keep = is_letter.copy()
    if len(keep):
        keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
    points, row = points[keep], row[keep]
    each = np.bincount(row, minlength=len(lower))
    pad = np.where(each > 0, ORDER - 1, 0)
    out = np.full(int((each + pad).sum()), _BLANK, np.uint32)
    out[np.arange(len(points)) + np.cumsum(pad)[row]] = points
    return out, np.concatenate(([0], np.cumsum(each + pad))), count


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each place from ORDER - 1 on."""
    n = len(points) - ORDER + 1
    h = np.full(max(0, n), order, np.uint64)
    for k in range(ORDER - order, ORDER):
        h = h * _U(0x9E3779B97F4A7C15) + points[k : k + n].astype(np.uint64)
    return mix(h)


def _ends(bounds: np.ndarray) -> np.ndarray:
    """Places of predicted characters, counted from ORDER - 1."""
    size = np.diff(bounds)
    return np.flatnonzero(np.repeat(size > 0, np.maximum(size, 0)) & (np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) >= ORDER - 1)) - (ORDER - 1)


def fit(lang: str, grams: list[str], counts: np.ndarray, symbols: int) -> Model:
    """A model from the counts of ORDER-grams, by interpolated Kneser-Ney smoothing.

    Lower orders count how many different characters stand before an n-gram.
    """
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    model = Model(lang, [], [], symbols)
    count = counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        h = np.full(len(points), order, np.uint64)
        c = np.full(len(points), order + ORDER, np.uint64)
        for k in range(order):
            h = h * _U(0x9E3779B97F4A7C15) + points[:, k].astype(np.uint64)
            if k < order - 1:
                c = c * _U(0x9E3779B97F4A7C15) + points[:, k].astype(np.uint64)
        h, (ctx, at) = mix(h), np.unique(mix(c), return_inverse=True)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = np.bincount(at, count)
        by = np.argsort(h)
        model.grams.insert(0, (h[by], (np.maximum(count - discount, 0) / total[at])[by]))
        model.contexts.insert(0, (ctx, np.bincount(at, np.minimum(count, discount)) / total))
        points, shown = np.unique(points[:, 1:], axis=0, return_inverse=True) if order > 1 else (points, at)
        count = np.bincount(shown.ravel()).astype(np.float64)
    return model


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], missing)


def entropies(col: pa.Array, models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy in nats a character [row, language], predicted characters, and letters of each row."""
    points, bounds, count = letters(col)
    ends = _ends(bounds)
    size = np.maximum(np.diff(bounds) - (ORDER - 1), 0)
    out = np.zeros((len(col), len(models)))
    if not len(ends):
        return out, size, count
    whole, first, which = np.unique(gram_hashes(points, ORDER)[ends], return_index=True, return_inverse=True)
    first = ends[first]
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        h = np.full(len(first), order, np.uint64)
        c = np.full(len(first), order + ORDER, np.uint64)
        for k in range(ORDER - order, ORDER):
            p = points[first + k].astype(np.uint64)
            h = h * _U(0x9E3779B97F4A7C15) + p
            if k < ORDER - 1:
                c = c * _U(0x9E3779B97F4A7C15) + p
        grams.append(mix(h))
        contexts.append(mix(c))
    upto = np.concatenate(([0], np.cumsum(size)))
    for j, m in enumerate(models):
        p = np.full(len(whole), 1 / m.symbols)
        for order in range(ORDER):
            p = _find(m.grams[order], grams[order], 0.0) + _find(m.contexts[order], contexts[order], 1.0) * p
        sums = np.concatenate(([0.0], np.cumsum(-np.log(p)[which])))[upto]
        out[:, j] = np.diff(sums) / np.maximum(size, 1)
    return out, size, count


def _sample(known: DataFrame, n: int) -> DataFrame:
    """At most n different (id, text) of each language, those with the smallest hashes: id, text, lang, rank.

    The window meets only rows whose hash lies below a language's bound, which
    its count of different rows sets so that about n + 8 * sqrt(n) + 64 do: fewer
    than n would be eight standard deviations off, and no task's share grows
    with the input, be it of one language or of repeated rows.
    """
    ranked = known.withColumn("rank", F.xxhash64("id", "text"))
    totals = ranked.groupBy("lang").agg(F.approx_count_distinct("rank", 0.02).alias("total"))
    near = ranked.join(few(save(totals, "totals")), "lang").where((F.col("rank") / 2.0**64 + 0.5) * F.col("total") <= 1.15 * (n + 8 * n**0.5 + 64))
    w = Window.partitionBy("lang").orderBy("rank")
    return near.dropDuplicates(["lang", "rank"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("id", "text", "lang", "rank")


_TABLE = "lang string, symbols long, size long, " + ", ".join(f"{t}{o}_{x} binary" for o in range(ORDER) for t in "gc" for x in ("hash", "value"))


def _packed(m: Model) -> pa.Table:
    flat = [a.tobytes() for o in range(ORDER) for t in (m.grams, m.contexts) for a in t[o]]
    names = [c.split()[0] for c in _TABLE.split(", ")]
    return pa.table([[m.lang], pa.array([m.symbols], pa.int64()), pa.array([sum(map(len, flat))], pa.int64()), *(pa.array([x], pa.binary()) for x in flat)], names=names)


def load(models: DataFrame) -> list[Model]:
    """The models of a table, in order of their languages."""
    out = []
    for r in sorted(models.toArrow().to_pylist(), key=lambda r: r["lang"]):
        tables = [[(np.frombuffer(r[f"{t}{o}_hash"], np.uint64), np.frombuffer(r[f"{t}{o}_value"])) for o in range(ORDER)] for t in "gc"]
        out.append(Model(r["lang"], *tables, r["symbols"], r.get("mean") or 0.0, r.get("spread") or 1.0))
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> DataFrame:
    """One row for each language of the learning folds: its model, from a bounded sample of whole texts.

    ``fit_docs`` and ``calibration_docs`` bound the documents a language, and so
    what the task that fits it holds.
    """
    known = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    part = fold("id", PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            langs = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                points, bounds, _ = letters(pa.array([t for t, x in zip(batch.column(0).to_pylist(), langs, strict=True) if x == lang], pa.string()))
                ends = _ends(bounds)
                if not len(ends):
                    continue
                _, first, n = np.unique(gram_hashes(points, ORDER)[ends], return_index=True, return_counts=True)
                text = points[(ends[first][:, None] + np.arange(ORDER)).ravel()].tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    sample = _sample(known.where((part != HELD) & (part != CALIBRATION)), fit_docs).select("text", "lang")
    grams = save(sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    symbols = grams.select(F.right("gram", F.lit(1))).distinct().count() + 1

    def fitted(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("gram")
        return _packed(fit(key[0].as_py(), t.column("gram").to_pylist(), t.column("n").to_numpy(), symbols))

    raw = save(grams.groupBy("lang").applyInArrow(fitted, _TABLE), "models")

    def limits(key: tuple, t: pa.Table) -> pa.Table:
        e, n = (t.column(c).to_numpy() for c in ("entropy", "n"))
        mean = float(np.median(e))
        return pa.table({"lang": [key[0].as_py()], "mean": [mean], "spread": [float(np.sqrt(np.mean((e - mean) ** 2 * np.minimum(n, 400))))], "seen": pa.array([len(e)], pa.int64())})

    own = _sample(known.where(part == CALIBRATION), calibration_docs)
    seen = score(own, raw, "id", "text", keep=("lang",)).where("lang = best and n > 0").select("lang", "entropy", "n")
    found = seen.groupBy("lang").applyInArrow(limits, "lang string, mean double, spread double, seen long").where("seen >= 2").drop("seen")
    full = raw.join(found, "lang", "left")
    return save(full.withColumns({"mean": F.coalesce("mean", F.log(F.col("symbols").cast("double"))), "spread": F.coalesce("spread", F.lit(1.0))}), "models")


def _scored(docs: DataFrame, models: list[Model], keep: tuple[str, ...], limit: float, last: bool) -> DataFrame:
    """One pass: (id, text, keep, what earlier passes found) to the same with these models seen, without the text after the last."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    first = "_best" not in docs.columns
    kept = ["_id", *([] if last else ["_text"]), *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names = np.array([*(m.lang for m in models), UNKNOWN], object)
        mean, spread = (np.array([*(getattr(m, k) for m in models), 0.0]) for k in ("mean", "spread"))
        for batch in slices(batches, "_text"):
            e, n, count = entropies(batch.column(1), models)
            some = (count > 0) & bool(models)
            warm = np.minimum(n, 64)
            best = e.argmin(axis=1) if models else np.zeros(len(n), int)
            low = e[np.arange(len(e)), best] if models else np.zeros(len(n))
            total = np.exp(-(e - low[:, None]) * warm[:, None]).sum(axis=1)
            room = limit * spread[best] / np.sqrt(np.clip(n, 1, 400))
            fits = some & (low - mean[best] <= room)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                trust = np.where(fits, 1.0, np.exp(1 - (low - mean[best]) / room) / 2)
            lang = names[np.where(some, best, len(models))]
            if not first:
                lang0, low0, total0, fits0, trust0 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_best", "_low", "_total", "_fits", "_trust"))
                new, least = low < low0, np.minimum(low, low0)
                total = total * np.exp(-(low - least) * warm) + total0 * np.exp(-(low0 - least) * warm)
                lang, fits, trust, low = np.where(new, lang, lang0), np.where(new, fits, fits0), np.where(new, trust, trust0), least
            cols = [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(lang, pa.string()), pa.array(np.where(some, low, 0.0)), pa.array(np.where(some, total, np.inf)), pa.array(fits.astype(bool)), pa.array(np.where(some, trust, 0.0)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "_best", "_low", "_total", "_fits", "_trust", "_n"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "_best string, _low double, _total double, _fits boolean, _trust double, _n long"]))


def score(docs: DataFrame, models: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), limit: float = 12.0) -> DataFrame:
    """id, the columns in ``keep``, best, score, entropy, n (predicted characters), accepted.

    Entropy counts as too high when it exceeds the language's mean by ``limit``
    of its spreads over the square root of n; short texts thus get more room.
    The score is the language's share among all models; that of a rejected text
    is at most half of it, and falls with what its entropy has beyond that room.
    """
    state = bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    passes = 0
    if models is not None:
        # Names and sizes alone, one row a language; the models themselves are read by the pass that needs them.
        turns, size = [[]], 0
        for r in models.select("lang", "size").orderBy("lang").collect():
            if size and size + r["size"] > PASS_BYTES:
                turns.append([])
                size = 0
            turns[-1].append(r["lang"])
            size += r["size"]
        for passes, langs in enumerate(filter(None, turns), 1):
            state = _scored(state, load(models.where(F.col("lang").isin(langs))), keep, limit, passes == len(turns))
    if not passes:
        state = _scored(state, [], keep, limit, True)
    return state.select(F.col("_id").alias(id_col), *keep, F.col("_best").alias("best"), (F.col("_trust") / F.col("_total")).alias("score"), F.col("_low").alias("entropy"), F.col("_n").alias("n"), F.col("_fits").alias("accepted"))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = score(docs, learn(docs))
    held = F.coalesce(fold("doc_id", PARTS) == HELD, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), F.col("best").alias("lang_pred"), "score", "accepted")

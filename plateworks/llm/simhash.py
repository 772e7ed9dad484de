"""SimHash near-duplicates by bit-sliced comparison of fingerprints.

Documents of one fingerprint form a class. Fingerprints that differ in few bits
agree on some block of bits, so classes are dealt into buckets by bits of each
block; with more classes, buckets take more bits, and then pairs and triples of
more blocks. Every pair within the radius shares a bucket, at every size.

In a bucket the fingerprints' bits are stored vertically: a plane holds one bit
of 64 fingerprints in each word. Planes are added into carry-save counters, one
bit of 64 distances in each word, which begin so that they overflow beyond the
radius; words whose distances have all overflowed are left out of the planes to
come. Buckets of more than BLOCK classes are cut into blocks, and each pair of
blocks is one unit of work. A unit gives one link for each class that it joins to
a smaller one, not all its pairs.

Null and blank texts have fingerprint zero and are linked like any other. A row
is one vertex: rows of one id and different texts are different ones, and repeated
rows are in one class. Rows without an id get their fingerprint and a null
component, and link nothing. An empty table gives no rows. Columns other than id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .components import components
from .shared import bounded, drop, few, save, with_class

WORDS, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Classes of a bucket that its number of bits aims at, and of a block of larger ones.
TARGET, BLOCK = 1024, 4096
#: Shingles counted together, words of distances compared together, and planes between two looks at which are left.
SHINGLES, CELLS, LOOK = 1 << 16, 1 << 15, 4
_FULL = ~np.uint64(0)


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half the hashes of the text's shingles; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    width = min(WORDS, len(words))
    joined = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in joined)
    n, ones = 0, np.zeros(BITS, np.int64)
    while len(part := np.fromiter(islice(hashes, SHINGLES), np.uint64)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())], names=["id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, fp long")


def masks(bits: int, radius: int = RADIUS) -> list[int]:
    """Masks of about ``bits`` bits, one of which any two fingerprints within the radius agree on.

    Of radius + 1 + more blocks, at least 1 + more are free of differing bits.
    """
    if bits <= 0:
        return [0]
    more = 0
    while BITS * (1 + more) // (radius + 1 + more) < bits and more < 3:
        more += 1
    blocks = np.array_split(np.arange(BITS), radius + 1 + more)
    out = []
    for chosen in combinations(blocks, 1 + more):
        places = np.concatenate(chosen)
        places = places[np.linspace(0, len(places) - 1, min(bits, len(places))).round().astype(int)]
        out.append(sum(1 << int(p) for p in places))
    return out


def planes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes [bit, word] of 64 fingerprints a word, and the words' places that none fills."""
    n, size = len(fps), -(-len(fps) // 64) * 64
    bits = np.zeros((BITS, size), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    none = (np.arange(size) >= n).astype(np.uint8)
    return tuple(np.packbits(x, axis=-1, bitorder="little").view("<u8") for x in (bits, none))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, equal: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of all a[i] and b[j] that differ in at most ``radius`` bits, some rows of a at a time.

    ``equal`` is a mask of bits that all share; they are compared last.
    """
    vertical, none = planes(b)
    n_words = len(none)
    order = sorted(range(BITS), key=lambda p: equal >> p & 1)
    width = max(1, radius.bit_length())
    begin = (1 << width) - 1 - radius
    for at in range(0, len(a), step := max(1, CELLS // n_words)):
        part = a[at : at + step].view(np.uint64)
        q, w = (x.ravel() for x in np.divmod(np.arange(len(part) * n_words), n_words))
        counters = [np.full(len(q), _FULL if begin >> k & 1 else 0, np.uint64) for k in range(width)]
        over = none[w]
        for k, p in enumerate(order):
            sign = np.where(part >> np.uint64(p) & np.uint64(1), _FULL, np.uint64(0))
            carry = vertical[p][w] ^ sign[q]
            for c in counters:
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
            if k % LOOK == LOOK - 1:
                left = over != _FULL
                if not left.all():
                    q, w, over, counters = q[left], w[left], over[left], [c[left] for c in counters]
                if not len(q):
                    break
        if len(q):
            cell, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield at + q[cell], 64 * w[cell] + bit


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n, the smallest number that the pairs join it to."""
    low = np.arange(n)
    for i, j in pairs:
        while True:
            apart = low[i] != low[j]
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            x, y = low[i], low[j]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
    return low


def close_links(classes: DataFrame, n_classes: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of fingerprints (fp, each once) that join all those within the radius, directly or over others."""
    table = masks(int(np.ceil(np.log2(max(1, n_classes / TARGET)))), radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in table]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed))))
    dealt = classes.select("fp", keys.alias("bucket")).select("fp", "bucket.*")
    large = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = save(large.select("mask", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    whole = dealt.join(few(large), ["mask", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    whole = whole.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    units = whole.select("mask", "key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    order = ["mask", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def links() -> pa.RecordBatch:
            own, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            mask, _, i, j = unit
            if i == j:
                low = joined(len(fp), close_pairs(fp, fp, radius, table[mask]))
            else:
                by = np.argsort(own, kind="stable")
                fp, cut = fp[by], int((own == i).sum())
                found = close_pairs(fp[:cut], fp[cut:], radius, table[mask]) if 0 < cut < len(fp) else iter(())
                low = joined(len(fp), ((x, y + cut) for x, y in found))
            more = np.flatnonzero(low != np.arange(len(low)))
            return pa.RecordBatch.from_arrays([pa.array(fp[more]), pa.array(fp[low[more]])], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            marks = np.stack([c.astype(np.int64) for c in cols[:4]])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                now = tuple(marks[:, x].tolist())
                if now != unit:
                    if held:
                        yield links()
                    unit, held = now, []
                held.append([c[x:y] for c in cols[4:]])
        if held:
            yield links()

    placed = units.repartition(*order).sortWithinPartitions(*order)
    return placed.select(*order, "own", "fp").mapInArrow(run, "a long, b long")


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, component_id: one row per row of docs."""
    rows = save(fingerprints(bounded(docs), id_col, text_col), "fingerprints")
    grouped = rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = save(grouped, "classes")
    links = save(close_links(classes, classes.count(), radius), "links")
    of = components(links)
    of = few(of.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(of.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()))
    linked = save(classes.join(of, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = classes.where("n > 1").join(few(linked.select("fp")), "fp", "left_anti").withColumnRenamed("least", "component_id")
    found = linked.join(few(least), "root").select("fp", "component_id", "n").unionByName(alone)
    out = with_class(rows, save(found, "components"), "fp")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    for t in (classes, links, linked):
        drop(t)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

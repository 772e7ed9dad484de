"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents with equal shingle sets form a class, which its smallest id stands
for. Signatures of classes are banded; classes that share a band are
candidates. Signatures are compared a batch of hashes at a time, and a pair is
dropped as soon as the posterior chance that it is similar enough falls below
the miss probability; what is left is confirmed on the full shingle sets.

Candidates come in two passes, and neither lists the pairs of a large bucket.
First each member meets the smallest of its bucket, and links join classes into
components. Then members of different components that share a bucket meet: in
small buckets as pairs, in large ones in blocks of bounded size, compared where
their texts are, so that only links come out. Members of a bucket's largest
component meet only those outside it, so a bucket of copies with few strangers
costs rows in proportion to its size. A pair is compared in the first band it
shares. No candidate is left out, whatever the size of its bucket.

Null and blank texts have no shingles and are linked with nothing. Repeated
rows, and rows with one id, count as one vertex; each row is returned. Rows
without an id get a null component and are kept. An empty table gives none.
Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import offsets, slices
from .components import components
from .shared import bounded, drop, few, save, with_class
from .sketch import band_keys, digest, linked, prune_table, shingle_sets, signatures, survivors

#: Percent of the union that the intersection must reach, the chance to miss a pair at a stage, and hashes a stage.
PERCENT, MISS, STEP = 75, 1e-6, 16
#: Members of buckets whose pairs are listed, members of a block of larger ones, and text bytes of a block (plus a text).
SMALL, BLOCK, BLOCK_BYTES = 64, 512, 4 << 20
#: Pairs of one member that go to one task.
HOT = 2000


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size (text bytes), n_shingles, digest, sig (16-bit hashes), bands of each row; the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1))
            some = [i for i, s in enumerate(sets) if len(s)]
            out: list[list] = [[None] * len(sets) for _ in range(3)]
            if some:
                sig = signatures([sets[i] for i in some])
                for k, (i, bands) in enumerate(zip(some, band_keys(sig).tolist(), strict=True)):
                    out[0][i], out[1][i], out[2][i] = digest(sets[i]), sig[k].astype("<u2").tobytes(), bands
            n = pa.array([len(s) for s in sets], pa.int64())
            size = pa.array(np.diff(offsets(batch.column(1))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], names=["id", "size", "n_shingles", "digest", "sig", "bands"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, size long, n_shingles long, digest binary, sig binary, bands array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (id, text) of the ids."""
    return docs.join(few(ids), "id", "left_semi").distinct()


def _confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links among pairs (a, b): the Bayesian test on signatures, then the full sets.

    Pairs of one a with many b, as a large bucket's smallest member has, are
    dealt over tasks by b, and a's text goes to each.
    """
    table = prune_table(PERCENT / 100, MISS, STEP)

    def bayes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in (2, 3)]
                yield batch.select([0, 1]).take(pa.array(survivors(*sigs, table)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "tb"):
                ta, tb = batch.column(2).dictionary_encode(), batch.column(3)
                a, b = shingle_sets(ta.dictionary), shingle_sets(tb)
                keep = [linked(a[k], y, PERCENT) for k, y in zip(ta.indices.to_pylist(), b, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sig = reps.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    left = save(both.select("a", "b", "sa", "sb").mapInArrow(bayes, "a long, b long").distinct(), "candidates")
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    texts = save(_texts_of(docs, ids), "texts")
    hubs = left.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hubs = few(save(hubs, "hubs"))
    shares = F.coalesce("parts", F.lit(1))
    dealt = left.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), shares).cast("int").alias("share"))
    own = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(hubs, "a", "left")
    own = own.select("a", "ta", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    full = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(own, ["a", "share"])
    links = save(full.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct(), "links")
    drop(left)
    drop(texts)
    return links


def _block_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between members of different components in large buckets.

    ``rows``: key, id, component, n (members of the bucket), main (its largest
    component), others (members outside it), bytes and other_bytes (of the texts
    of all members and of those outside it). Members are dealt over blocks by
    hash, those outside the largest component first, and each pair of blocks is
    one unit of work, except pairs of two blocks of the largest component.
    """
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    outer, inner = blocks(F.col("others"), F.col("other_bytes")), blocks(F.col("n") - F.col("others"), F.col("bytes") - F.col("other_bytes"))
    is_main, at = F.col("component") == F.col("main"), F.xxhash64("id")
    own = F.when(is_main, outer + F.pmod(at, inner)).otherwise(F.pmod(at, outer)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_main, outer - 1).otherwise(outer + inner - 1)))
    dealt = rows.select("key", "id", "component", own.alias("own"), other.alias("other"))
    units = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component").distinct()
    table = prune_table(PERCENT / 100, MISS, STEP)

    def work(key: int, ids: list[int], comp: np.ndarray, own: np.ndarray, inside: bool, texts: pa.Array) -> Iterator[tuple[int, int]]:
        sets = shingle_sets(texts)
        sig = signatures(sets)
        bands = band_keys(sig)
        band = int(np.flatnonzero((bands == key).all(axis=0))[0])
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for p in range(len(ids)):
            q = np.arange(p + 1, len(ids))
            q = q[(comp[q] != comp[p]) & ((own[q] != own[p]) | inside)]
            q = q[~(bands[q, :band] == bands[p, :band]).any(axis=1)]
            for k in q[survivors(np.broadcast_to(sig[p], (len(q), sig.shape[1])), sig[q], table)].tolist():
                if find(p) != find(k) and linked(sets[p], sets[k], PERCENT):
                    root[find(p)] = find(k)
                    yield ids[p], ids[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def links() -> pa.RecordBatch:
            found = []
            if len({r[5] for r in held}) > 1:
                found = list(work(unit[0], [r[4] for r in held], np.array([r[5] for r in held]), np.array([r[3] for r in held]), unit[1] == unit[2], pa.array([r[6] for r in held])))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != unit:
                    if held:
                        yield links()
                    unit, held = row[:3], []
                held.append(row)
        if held:
            yield links()

    ids = rows.select("id").distinct()
    with_text = units.join(_texts_of(docs, ids), "id").select("key", "i", "j", "own", "id", "component", "text")
    sorted_units = with_text.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return save(sorted_units.mapInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of docs."""
    slim = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = save(sketches(slim, "id", "text"), "sketch")
    some = sketch.where("digest is not null and id is not null")
    copies = save(some.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    # Rows of no class of copies stand for themselves: their signatures stay where they are.
    marked = with_class(some, copies, "digest")
    firsts = marked.where("id = rep").dropDuplicates(["id", "digest"])
    reps = save(marked.where("rep is null").unionByName(firsts).select("id", "size", "sig", "bands"), "classes")

    banded = reps.select("id", "size", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    members = save(banded.join(buckets, "key"), "members")
    star = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    texts = slim.where("id is not null")
    links = _confirm(texts, reps, star)
    joined = components(links)

    placed = members.join(joined.select(F.col("u").alias("id"), "v"), "id", "left").select("key", "id", "size", "n", "bytes", F.coalesce("v", "id").alias("component"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("size").alias("size"))
    most = F.struct("k", "component")
    open_keys = shares.groupBy("key").agg(F.max_by("component", most).alias("main"), (F.sum("k") - F.max("k")).alias("others"), (F.sum("size") - F.max_by("size", most)).alias("other_bytes")).where("others > 0")
    rest = save(placed.join(open_keys, "key"), "members")
    small, many = rest.where(F.col("n") <= SMALL), rest.where(F.col("n") > SMALL)
    left, right = (small.select("key", F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("a", "ca"), ("b", "cb")))
    pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    more = _confirm(texts, reps, pairs).unionByName(_block_links(texts, many))
    final = save(components(joined.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more)), "components")

    of = final.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    classes = copies.join(of, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), "n")
    out = with_class(sketch.select("id", "n_shingles", "digest"), save(classes, "classes"), "digest")
    # Rows without an id are not dealt out by it.
    known = out.where("id is not null").join(few(of.withColumnsRenamed({"rep": "id", "component": "linked"})), "id", "left")
    out = known.unionByName(out.where("id is null"), allowMissingColumns=True)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", F.when(F.col("digest").isNotNull(), F.col("linked")), "id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
    for t in (reps, members, rest):
        drop(t)
    return out


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB has no recursion bound, so components are closed by a recursive union over links.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS n, sh, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(sh), chr(10)))) AS rep FROM s),
u AS (SELECT rep, n, unnest(sh) AS g FROM c WHERE doc_id = rep AND n > 0),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT c.doc_id, c.n AS n_shingles,
       CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(m.component_id, c.rep) END AS component_id,
       c.doc_id = CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(m.component_id, c.rep) END AS kept
FROM c LEFT JOIN m ON m.x = c.rep
"""

"""Packing of documents into token windows by best-fit decreasing.

Each partition packs what it holds, a bounded number of tokens at a time, so no
shuffle and no global state are needed. Documents longer than a window are
first cut into full windows; the rests, longest first, go to the open window
with the least room that still holds them, found in a segment tree indexed by
remaining capacity.

Null texts are empty documents (their end token alone); null ids, repeated rows
and empty tables pass through; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .encode import ENCODE_BYTES, Memory, encode, vocabulary
from .shared import bounded

WINDOW, END_ID = 4096, 2
#: Tokens packed together at most (plus one document).
CHUNK_TOKENS = 16 << 20


class OpenWindows:
    """A segment tree over remaining capacities; a leaf stacks the windows with that room."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.stacks: dict[int, list[int]] = {}

    def push(self, room: int, window: int) -> None:
        self.stacks.setdefault(room, []).append(window)
        self._add(room, 1)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take the window with the least room of at least size: (room, window)."""
        node, count = size + self.base, self.count
        while not count[node]:
            while node & 1:  # a right child has nothing further right below its parent
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # stepped off the right edge of its level
                return None
        while node < self.base:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.base
        self._add(room, -1)
        return room, self.stacks[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = room + self.base
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    pieces, rests, used = [], [], 0
    for doc, n in enumerate(lengths.tolist()):
        full = n // window
        for k in range(full):
            pieces.append((doc, k * window, window, used, 0))
            used += 1
        if n % window or not n:
            rests.append((n % window, doc, full * window))
    rests.sort(key=lambda r: -r[0])
    tree = OpenWindows(window)
    for size, doc, start in rests:
        room, seq = tree.pop_tightest(size) or (window, used)
        used = max(used, seq + 1)
        pieces.append((doc, start, size, seq, window - room))
        if room > size:
            tree.push(room - size, seq)
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, tokens.

    ``tokens`` are the piece's ids as little-endian unsigned 32-bit integers.
    Sequence ids are unique over the table: partition, then a running number.
    """
    path = tokenizer or vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held_ids: list = []
        held: list[np.ndarray] = []
        total = 0
        memory = Memory()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held_ids, held, total
            pieces = best_fit(np.array([len(h) for h in held]), window)
            for k in range(0, len(pieces), 4000):
                part = pieces[k : k + 4000]
                cols = [
                    [held_ids[d] for d, *_ in part],
                    [s for _, s, *_ in part],
                    [n for _, _, n, *_ in part],
                    [len(held[d]) for d, *_ in part],
                    [sequence + q for *_, q, _ in part],
                    [o for *_, o in part],
                    [held[d][s : s + n].tobytes() for d, s, n, *_ in part],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            sequence += max((q for *_, q, _ in pieces), default=-1) + 1
            held_ids, held, total = [], [], 0

        names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens"]
        types = [None, *[pa.int64()] * 5, pa.binary()]
        for batch in slices(batches, "text", ENCODE_BYTES):
            types[0] = batch.schema.field("id").type
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), path, end_id, memory), strict=True):
                held_ids.append(key)
                held.append(ids)
                total += len(ids)
                if total >= CHUNK_TOKENS:
                    yield from flush()
        yield from flush() if held else ()

    slim = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, `offset` long, tokens binary"
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    p = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

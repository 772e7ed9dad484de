"""Token counts by a linear longest-match automaton.

The trie of a vocabulary gets, for each node, a failure link and the number of
pieces popped on the way to it, computed once. Matching a word then follows one
edge a character and adds up popped counts; no piece is ever built. Pieces with
the word mark in front begin a word, the others continue one. A word with no
full cover is one unknown token.

Words are runs of characters other than ASCII white space. Each distinct word of
a slice is matched once, all of them in step; very long words one at a time.
Null and empty texts count 0; repeated rows get one row each; an empty table
gives none. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Text, slices
from .shared import bounded

MARK = "▁"
#: Longer words are matched one at a time.
IN_STEP = 64
_NONE = -1


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a public SentencePiece model without control, unknown and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Automaton:
    """The trie as sorted (node, character) keys, with failure links and popped counts."""

    def __init__(self, pieces: list[str]):
        edges: list[dict[str, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    final.append(False)
                node = edges[node][c]
            final[node] = True
        fail, pops = [_NONE] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            below = []
            for node in level:
                for c, child in edges[node].items():
                    below.append(child)
                    if final[child]:
                        fail[child], pops[child] = 0, 1
                        continue
                    at, n = fail[node], pops[node]
                    while at != _NONE and c not in edges[at]:
                        n += pops[at]
                        at = fail[at]
                    if at != _NONE:
                        fail[child], pops[child] = edges[at][c], n
            level = below
        self.edges, self.fail, self.pops = edges, np.array(fail), np.array(pops)
        keys = np.array([node << 21 | ord(c) for node, out in enumerate(edges) for c in out], np.int64)
        by = np.argsort(keys)
        self.keys, self.children = keys[by], np.array([child for out in edges for child in out.values()])[by]

    def step(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Children of these nodes, or _NONE."""
        key = node << 21 | point
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], _NONE)

    def count(self, word: str) -> int:
        """Pieces of one word, or -1 if it has no cover."""
        node, n = 0, 0
        for c in MARK + word:
            while c not in self.edges[node]:
                n += int(self.pops[node])
                node = int(self.fail[node])
                if node == _NONE:
                    return -1
            node = self.edges[node][c]
        while node:
            n += int(self.pops[node])
            node = int(self.fail[node])
            if node == _NONE:
                return -1
        return n

    def count_all(self, words: list[str]) -> np.ndarray:
        """Pieces of each word, or -1."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        for i in np.flatnonzero(size > IN_STEP):
            out[i] = self.count(words[i])
        short = np.flatnonzero(size <= IN_STEP)
        short = short[np.argsort(-size[short], kind="stable")]
        if not len(short):
            return out
        # Longest first, so the words still running are a prefix.
        points = np.zeros((len(short), IN_STEP), np.int64)
        flat = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le"), np.uint32)
        n = size[short]
        points[np.repeat(np.arange(len(short)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        start = self.edges[0].get(MARK, _NONE)
        node, total = np.full(len(short), start), np.zeros(len(short), np.int64)
        for k in range(int(n[0]) if start != _NONE else 0):
            run = np.flatnonzero((n > k) & (node != _NONE))
            while len(run):
                to = self.step(node[run], points[run, k])
                hit = to != _NONE
                node[run[hit]] = to[hit]
                run = run[~hit]
                total[run] += self.pops[node[run]]
                node[run] = self.fail[node[run]]
                run = run[node[run] != _NONE]
        run = np.flatnonzero(node > 0)
        while len(run):
            total[run] += self.pops[node[run]]
            node[run] = self.fail[node[run]]
            run = run[node[run] > 0]
        out[short] = np.where(node == 0, total, -1)
        return out


#: The automaton that this worker built last, by its vocabulary.
_BUILT: dict[int, Automaton] = {}


def _automaton(pieces: list[str]) -> Automaton:
    key = hash(tuple(pieces))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(pieces)
    return _BUILT[key]


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens, n_unknown of every whole text. The automaton's size is that of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in slices(batches, "text", 4 << 20):
            words = Text(batch.column(1)).words()
            n = np.diff(words.first)
            tokens = unknown = np.zeros(len(n), np.int64)
            if len(words):
                coded = words.strings().dictionary_encode()
                count = automaton.count_all([w.strip(" \t\n\v\f\r") for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
                tokens, unknown = (np.diff(np.concatenate(([0], np.cumsum(x)))[words.first]) for x in (np.where(count < 0, 1, count), count < 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, tokens, unknown))], names=["id", "n_words", "n_tokens", "n_unknown"])

    slim = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())

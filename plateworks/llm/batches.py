"""Arrow text columns as numpy arrays: slices of bounded size, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one step holds in memory, unless a single text is longer.
SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)

SPACE, WORD, MARK = 0, 1, 2
_BLANK = np.full(256, WORD, np.uint8)
_BLANK[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND = _BLANK.copy()
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = MARK
#: What each byte adds to a word's hash: A-Z as a-z, white space nothing.
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_BLANK == SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Factors of the places in a word; those of later places are computed when they occur.
_PLACES = mix(np.arange(1, (1 << 12) + 1, dtype=np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        ends = np.cumsum(np.diff(offsets(col)))
        at = 0
        while at < len(col):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than rows."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    buf = col.buffers()[1]
    if buf is None or not len(col):
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


class Text:
    """The bytes of a string array and the rows' bounds in them; nulls are empty."""

    def __init__(self, col: pa.Array):
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) else b"")
        off = offsets(col)
        data = col.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[off[0] : off[-1]]
        self.bounds = off - off[0]

    def words(self, kinds: np.ndarray = _BLANK) -> Words:
        """Longest runs of bytes of one kind, white space left out; none spans two rows."""
        kind = kinds[self.data]
        n = len(kind)
        edge = np.ones(n + 1, bool)
        if n:
            edge[1:n] = kind[1:] != kind[:-1]
            edge[self.bounds] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        if n:
            keep = kind[start] != SPACE
            start, end = start[keep], end[keep]
        return Words(self, start, end)


class Words:
    """Word spans of a :class:`Text`; ``first[i]`` is row i's first word."""

    def __init__(self, text: Text, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end
        self.first = np.searchsorted(start, text.bounds)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, head: int = 0) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``head`` bytes; A-Z lower-cased.

        Each byte's value is multiplied by a factor of its place in the word; the
        factors follow no rule that words could follow too.
        """
        if not len(self):
            return np.zeros(0, np.uint64)
        at = self.start[0]
        place = np.arange(len(self.text.data) - at, dtype=np.int32 if len(self.text.data) < 1 << 31 else np.int64)
        place -= np.repeat(self.start - at, np.diff(np.append(self.start, len(self.text.data)))).astype(place.dtype)
        if int((self.end - self.start).max()) <= len(_PLACES):
            np.minimum(place, len(_PLACES) - 1, out=place)  # only white space lies further on
            product = _PLACES[place]
        else:
            product = mix(place.astype(np.uint64) + _U(1))
        product *= _BYTE[self.text.data[at:]]
        if head:
            product[place >= head] = 0
        return mix(np.add.reduceat(product, self.start - at))

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def strings(self) -> pa.Array:
        """Each word with the white space after it, as a string array on the same bytes."""
        ends = np.append(self.start, len(self.text.data)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.text.data)))


def kinds_words(text: Text) -> Words:
    """Runs of letters and digits, and runs of ASCII marks, as separate words."""
    return text.words(_KIND)


def ngrams(h: np.ndarray, rows: np.ndarray, gaps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word tuples (i, i+gap1, i+gap1+gap2, ...) that lie in one row, and their rows."""
    reach = sum(gaps)
    n = len(h) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out, at = h[:n] ^ _U(salt), 0
    for gap in gaps:
        at += gap
        out = mix(out) + h[at : at + n]
    same = rows[:n] == rows[reach:]
    return mix(out)[same], rows[:n][same]

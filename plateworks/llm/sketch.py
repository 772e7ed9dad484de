"""Shingle sets, MinHash signatures, bands, and the sequential Bayesian test."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa

from .batches import Text, mix, ngrams

_U = np.uint64
WORDS = 5
#: A pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 4) ** 32 < 6e-6.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
_RNG = np.random.default_rng(20240502)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) << _U(1) | _U(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Shingles whose permutations are taken together, so that they stay in cache.
_BLOCK = 1 << 14


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles of WORDS words; of the whole text if it has fewer."""
    words = Text(col).words()
    h, rows = words.hashes(), words.rows()
    g, r = ngrams(h, rows, (1,) * (WORDS - 1), 0)
    bounds = np.searchsorted(r, np.arange(len(col) + 1))
    out = [np.unique(g[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    n = np.diff(words.first)
    for i in np.flatnonzero((n > 0) & (n < WORDS)):
        x = np.array([n[i]], np.uint64)
        for k in range(words.first[i], words.first[i + 1]):
            x = mix(x) + h[k : k + 1]
        out[i] = mix(x)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures [row, hash] of non-empty sets, 32 bits each."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    ends = np.cumsum(size)
    out = np.full((len(sets), HASHES), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(flat), _BLOCK):
        part = flat[at : at + _BLOCK]
        row = int(np.searchsorted(ends, at, "right"))
        last = int(np.searchsorted(ends, at + len(part) - 1, "right"))
        starts = np.maximum(ends[row : last + 1] - size[row : last + 1] - at, 0)
        for k in range(HASHES):
            v = ((part * _A[k] + _B[k]) >> _U(32)).astype(np.uint32)
            np.minimum(out[row : last + 1, k], np.minimum.reduceat(v, starts), out=out[row : last + 1, k])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys [row, band]; equal keys mean an equal band."""
    x = np.arange(1, BANDS + 1, dtype=np.uint64) * np.ones((len(sig), 1), np.uint64)
    for k in range(BAND_ROWS):
        x = mix(x) + sig[:, k::BAND_ROWS].astype(np.uint64)
    return mix(x).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def prune_table(similarity: float, miss: float, step: int) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on) of each stage.

    With a uniform prior, the similarity after m matches of n is Beta(m + 1, n - m + 1),
    and P(similarity >= s) is the chance that a binomial of n + 1 draws at s is at
    most m. A pair is dropped where that falls below ``miss``.
    """
    out = []
    for n in range(step, HASHES + 1, step):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the pairs of signature rows that no stage drops."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    done = 0
    for n, least in table:
        matches[left] += (a[left, done:n] == b[left, done:n]).sum(axis=1)
        left = left[matches[left] >= least]
        done = n
    return left


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    k = int((y[at] == x).sum())
    return 100 * k >= percent * (len(x) + len(y) - k)

"""SimHash near-duplicates and bit-sliced comparison against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plateworks.llm import simhash

DOC = "doc_id long, text string, fp long, id string, n int, mask int"
WORDS = [f"w{i}" for i in range(400)] + ["É", "the", "THE"]


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _expected(rows):
    fps = [_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = [k for k, r in enumerate(rows) if r[0] is not None]
    for k, a in enumerate(some):
        for b in some[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k in some:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return sorted(((i, f"{fps[k]:016x}", None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def _rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "one two", "One  TWO", "a b c", "a b c", " ".join(rng.choices(WORDS, k=40000))]
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randrange(60, 900))
        texts.append(" ".join(base))
        for _ in range(8):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(WORDS)
            texts.append("  ".join(base).title())
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[3], (None, texts[9]), (None, None), (rows[9][0], texts[20])]


@pytest.mark.parametrize(("target", "block"), [(1024, 4096), (4, 4096), (1024, 16), (0.001, 8)])
def test_duplicates_equal_brute_force(spark, monkeypatch, target, block):
    monkeypatch.setattr(simhash, "TARGET", target)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOC)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_duplicates(docs).collect()), key=repr)
    want = _expected(rows)
    assert got == want and len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_no_rows_and_the_engine_s_own_hash(spark):
    assert simhash.simhash_duplicates(spark.createDataFrame([], DOC)).collect() == []
    text = "three words é"
    (r,) = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert r.h == simhash.fingerprint(text.encode())


def _near(rng, n):
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [rng.choice(centres) for _ in range(n)]
    for k in range(n):
        for _ in range(rng.randrange(6)):
            fps[k] ^= 1 << rng.randrange(64)
    return np.array([f - (1 << 64) if f >> 63 else f for f in fps], np.int64)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
@pytest.mark.parametrize("n", [1, 64, 65, 300])
def test_bit_sliced_pairs_equal_popcounts(radius, n, monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 128)
    a, b = _near(random.Random(n), n), _near(random.Random(n), n + 7)
    want = {(i, j) for i, x in enumerate(a.tolist()) for j, y in enumerate(b.tolist()) if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius}
    got = [p for i, j in simhash.close_pairs(a, b, radius) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("bits", [0, 1, 7, 16, 17, 25, 31, 36, 60])
def test_some_mask_is_free_of_any_three_bits(bits):
    table, rng = simhash.masks(bits), random.Random(bits)
    assert min(m.bit_count() for m in table) >= min(bits, 36)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & flips for m in table)

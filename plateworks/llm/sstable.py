"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order:

    data section ...   entries: shared, unshared, value length (varints),
                       key suffix, value; the first key of a section is whole
    index section      last key, offset and length of each data section
    Bloom section      bit array over the keys
    footer (64 bytes)  positions of index and Bloom filter, entries, ids, magic

Every section ends in its crc32 and a newline. Keys are ids as big-endian
unsigned integers with the sign bit flipped, so byte order is number order;
null ids have the empty key and come first. Values are ids, two bytes each
where the vocabulary allows, else four. A manifest names each shard's first and
last key and what it holds, so that a search opens only shards that may hold an
asked-for id.

Null texts are empty documents (their end id alone). Repeated ids keep all
their rows, ordered by a hash of their texts, and may lie in several shards.
Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import slices
from .encode import Memory, encode, vocabulary, vocabulary_size
from .shared import bounded, few, shared_dir

MAGIC = b"PWSST001"
END_ID, SECTION_BYTES, SHARD_TEXT_BYTES = 1, 64 << 10, 16 << 20
#: Text bytes encoded together, and words remembered in place of longer slices, whose arrays would be held beside a sort.
ENCODE_BYTES, REMEMBERED = 2 << 20, 150_000
_FOOTER = struct.Struct("<QQQQQQHHxxxx8s")
_BLOOM_BITS, _BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _entry(last: bytes, key: bytes, value: bytes) -> bytes:
    shared = 0
    while shared < min(len(last), len(key)) and last[shared] == key[shared]:
        shared += 1
    return _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value


def _entries(section: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, key = 0, b""
    while at < len(section):
        shared, at = _read_varint(section, at)
        own, at = _read_varint(section, at)
        n, at = _read_varint(section, at)
        key = key[:shared] + bytes(section[at : at + own])
        yield key, section[at + own : at + own + n]
        at += own + n


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(_BLOOM_PROBES)]


def shard_sections(rows: Iterator[tuple[int | None, np.ndarray]], width: int) -> Iterator[bytes]:
    """Sections of one shard for rows in key order, each without its newline."""
    at = n_ids = 0
    index, keys, buf, last = bytearray(), [], bytearray(), b""

    def close(section: bytes) -> bytes:
        nonlocal at
        at += len(section) + 5
        return section + struct.pack("<I", zlib.crc32(section))

    def data_section() -> bytes:
        nonlocal index
        index += _entry(b"", keys[-1], struct.pack("<QQ", at, len(buf)))
        return close(bytes(buf))

    for doc_id, ids in rows:
        key = key_of(doc_id)
        if len(buf) >= SECTION_BYTES:
            yield data_section()
            buf, last = bytearray(), b""
        if len(ids) and int(ids.max()) >> 8 * width:
            raise ValueError(f"id {ids.max()} needs more than {width} bytes")
        buf += _entry(last, key, ids.astype(f"<u{width}").tobytes())
        keys.append(key)
        last, n_ids = key, n_ids + len(ids)
    if not keys:
        return
    yield data_section()
    index_at = at
    yield close(bytes(index))
    bits = max(64, _BLOOM_BITS * len(keys))
    bloom = np.zeros(bits, np.uint8)
    for key in keys:
        bloom[_probes(key, bits)] = 1
    packed = np.packbits(bloom).tobytes()
    bloom_at = at
    yield close(packed)
    yield _FOOTER.pack(index_at, len(index), bloom_at, bits, len(keys), n_ids, width, 1, MAGIC)


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes | memoryview):
        if data[-1:] != b"\n" or data[-9:-1] != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.data = data
        self.index_at, self.index_len, self.bloom_at, self.bits, self.n_docs, self.n_ids, self.width, _, _ = _FOOTER.unpack(data[-1 - _FOOTER.size : -1])

    def _section(self, at: int, n: int) -> bytes:
        section = self.data[at : at + n]
        if zlib.crc32(section) != struct.unpack_from("<I", self.data, at + n)[0]:
            raise ValueError(f"section at {at} is damaged")
        return section

    def index(self) -> list[tuple[bytes, int, int]]:
        return [(k, *struct.unpack("<QQ", v)) for k, v in _entries(self._section(self.index_at, self.index_len))]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, n in self.index():
            for key, value in _entries(self._section(at, n)):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}").astype(np.uint32)

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document with this id: Bloom filter, then binary search in the index."""
        key = key_of(doc_id)
        bloom = self._section(self.bloom_at, (self.bits + 7) // 8)
        if not all(bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return []
        index = self.index()
        low, high = 0, len(index)
        while low < high:
            mid = (low + high) // 2
            if index[mid][0] < key:
                low = mid + 1
            else:
                high = mid
        found = []
        for last, at, n in index[low:]:
            found += [np.frombuffer(v, f"<u{self.width}").astype(np.uint32) for k, v in _entries(self._section(at, n)) if k == key]
            if last > key:
                break
        return found


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, width: int | None = None) -> None:
    """Encode all documents and write shards, part files in ascending id order, and their manifest.

    One shuffle, of texts by id range; the number of ranges follows the text
    bytes. ``width`` is the bytes of an id, by default as many as the vocabulary
    needs; one that an id doesn't fit is an error.
    """
    vocab = tokenizer or vocabulary()
    width = width or (2 if max(vocabulary_size(vocab) - 1, end_id) < 1 << 16 else 4)
    slim = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            memory = Memory(REMEMBERED)
            for batch in slices(batches, "text", ENCODE_BYTES):
                yield from zip(batch.column(0).to_pylist(), encode(batch.column(1), vocab, end_id, memory), strict=True)

        for section in shard_sections(rows(), width):
            yield pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], names=["section"])

    # The texts' hashes part rows of one id, so that a repeated or null id fills more than one shard.
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"))
    parts = slim.repartitionByRange(max(1, -(-size // SHARD_TEXT_BYTES)), *order).sortWithinPartitions(*order)
    parts.mapInArrow(run, "section binary").select(F.col("section").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)
    _manifest(docs.sparkSession, path).write.parquet(f"{path}/_manifest")


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    f = spark.read.format("binaryFile").load(paths).where("length > 0")
    return f.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content", "path")


def _scan(files: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows_of(batch.column(0)[i].as_py(), Shard(memoryview(batch.column(1)[i].as_buffer()).cast("B")))

    return files.select("shard", "content").mapInArrow(run, schema)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, path, low and high (hexadecimal keys), n_docs, n_ids of each shard, from its index and footer."""

    def held(shard: int, s: Shard) -> Iterator[pa.RecordBatch]:
        index = s.index()
        low = next(_entries(s._section(*index[0][1:])))[0]
        row = [shard, low.hex(), index[-1][0].hex(), s.n_docs, s.n_ids]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "low", "high", "n_docs", "n_ids"])

    files = _files(spark, path)
    return _scan(files, "shard int, low string, high string, n_docs long, n_ids long", held).join(files.select("shard", "path"), "shard")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens (little-endian unsigned 32-bit) of every stored document."""

    def documents(shard: int, s: Shard) -> Iterator[pa.RecordBatch]:
        ids, tokens, starts, at = [], [], [], 0
        for k, (doc_id, t) in enumerate(s.documents(), 1):
            ids.append(doc_id)
            starts.append(at)
            tokens.append(t.tobytes())
            at += len(t)
            if len(ids) == 4000 or k == s.n_docs:
                n = pa.array([len(t) // 4 for t in tokens], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), n, pa.array(tokens, pa.binary())], names=["shard", "doc_id", "local", "n_tokens", "tokens"])
                ids, tokens, starts = [], [], []
        if at != s.n_ids:
            raise ValueError(f"shard {shard} holds {at} ids; its footer says {s.n_ids}")

    rows = _scan(_files(spark, path), "shard int, doc_id long, local long, n_tokens long, tokens binary", documents)
    # One row a shard, so this unpartitioned window is short at any size.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = spark.read.parquet(f"{path}/_manifest").select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(few(base), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "tokens")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and tokens of the asked-for documents: shards by the manifest, then Bloom filter and binary search in each."""

    def hits(_: int, s: Shard) -> Iterator[pa.RecordBatch]:
        found = [(i, t.tobytes()) for i in doc_ids for t in s.find(i)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["doc_id", "tokens"])

    schema = "doc_id long, tokens binary"
    asked = spark.createDataFrame([(key_of(i).hex(),) for i in set(doc_ids)], "key string")
    near = spark.read.parquet(f"{path}/_manifest").join(F.broadcast(asked), F.col("key").between(F.col("low"), F.col("high")))
    # As many paths at most as shards that may hold one of the ids.
    paths = [r.path for r in near.select("path").distinct().collect()]
    return _scan(_files(spark, paths), schema, hits) if paths else spark.createDataFrame([], schema)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "sstable")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))

"""WARC archives: writing with segmentation and revisits, reading with reassembly.

A page becomes an HTTP response in chunked transfer framing. A block longer
than a segment is written as a first record and continuation records, which
name the first as their origin. The reader groups continuation records by
origin, orders them by segment number, checks that none is missing and that the
lengths add up to the total that the last one states, then decodes the chunks.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with
the smallest id is written as a response and the others as revisits of it. Null
payloads are empty; a null id is kept and never comes first; rows with the same
id and payload are written one by one, each under a record id that also names
its task and place. Empty tables give empty archives. Other columns are not
read.
"""

from __future__ import annotations

import gzip
import io
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, save, shared_dir, with_class

MIN_REVISIT, SEGMENT_BYTES, CHUNK_BYTES = 100, 64 << 10, 8 << 10
#: Records are written in runs of so many bytes (plus a record), and so many runs to a file.
RUN_BYTES, FILE_RUNS = 1 << 20, 64
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(c), c) for k in range(0, len(payload), CHUNK_BYTES) if (c := payload[k : k + CHUNK_BYTES])]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes, copy: str = "") -> Iterator[bytes]:
    """Records of one page; ``copy`` tells rows of one id and payload apart."""
    record = f"<urn:x-page:{page_id if page_id is not None else ''}:{digest[:32]}{copy and ':' + copy}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:x-page:unnamed"
    kind = "response" if refers_to is None else "revisit"
    common = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        common.append(("X-Page-ID", page_id))
    if refers_to is not None:
        head = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record([*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{digest[:32]}>")], head)
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record(common, block)
        return
    cuts = range(0, len(block), SEGMENT_BYTES)
    for k, at in enumerate(cuts, 1):
        head = common if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", record), ("WARC-Target-URI", uri), ("WARC-Date", DATE)]
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(cuts) else []
        yield _record([*head, ("WARC-Segment-Number", k), *total], block[at : at + SEGMENT_BYTES])


def read_records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of an archive."""
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = file.read(n := int(head["content-length"]))
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as gzip-compressed WARC files.

    Only digests and ids are shuffled, to learn which come first; payloads stay
    in their tasks unless more digests repeat than can be broadcast.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    each = rows.groupBy("digest", "id").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    firsts = each.groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.max("n").alias("times"), F.max("size").alias("size")).where("n > 1")
    marked = with_class(rows, save(firsts, "firsts"), "digest")
    other = F.col("first").isNotNull() & (F.col("size") >= MIN_REVISIT) & ~F.col("id").eqNullSafe(F.col("first"))
    marked = marked.select("id", "url", "digest", F.when(other, F.col("first")).alias("refers_to"), "payload", (F.col("times") > 1).alias("repeated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            for *row, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k += 1
                for r in page_records(*row, f"{part}-{k}" if repeated else ""):
                    held.append(r)
                    size += len(r)
                    if size > RUN_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)], pa.binary())], names=["records"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_END.join(held)], pa.binary())], names=["records"])

    runs = marked.mapInArrow(run, "records binary").select(F.col("records").cast("string"))
    runs.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RUNS).text(path)


_SEGMENT = "origin string, number int, total long, page_id long, type string, refers_to long, digest string, block binary"


def _segments(files: DataFrame) -> DataFrame:
    """Records of the archives, one row each; those that are parts of one have a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for h, block in read_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    target = h.get("warc-refers-to", "").split(":")
                    rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"), number("x-page-id"), h["warc-type"], int(target[2]) if len(target) > 2 and target[2] else None, h.get("warc-payload-digest"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, _SEGMENT)


def reassemble(numbers: list[int], totals: list[int | None], blocks: list[bytes]) -> list[bytes]:
    """The blocks of one origin put together; as many results as it was written times."""
    by: dict[int, list[bytes]] = {}
    for n, b in zip(numbers, blocks, strict=True):
        by.setdefault(n, []).append(b)
    copies = set(map(len, by.values()))
    total = {t for t in totals if t is not None}
    if sorted(by) != list(range(1, len(by) + 1)) or len(copies) != 1 or len(total) != 1:
        raise ValueError(f"segments {dict(Counter(numbers))}, totals {total}")
    whole = b"".join(by[n][0] for n in sorted(by))
    if len(whole) != total.pop():
        raise ValueError("the segments' length is not the total that the last one states")
    return [whole] * copies.pop()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def join(table: pa.Table) -> pa.Table:
        d = table.to_pydict()
        (k,) = [i for i, n in enumerate(d["number"]) if n == 1][:1] or [0]
        blocks = reassemble(d["number"], d["total"], d["block"])
        one = {c: [d[c][k]] * len(blocks) for c in ("origin", "number", "total", "page_id", "type", "refers_to", "digest")}
        return pa.table({**one, "block": blocks}, schema=table.schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes = [], []
            for block in batch.column(batch.schema.get_field_index("block")).to_pylist():
                head, _, body = block.partition(b"\r\n\r\n")
                if b"Transfer-Encoding: chunked" in head:
                    payloads.append(unchunked(body))
                    sizes.append(len(payloads[-1]))
                else:
                    payloads.append(None)
                    sizes.append(int(re.search(rb"Content-Length: (\d+)", head)[1]))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64())], names=["page_id", "record_type", "refers_to", "digest", "payload", "payload_bytes"])

    # Saved, so that each archive is read once for whole records and parts.
    records = save(_segments(files), "records")
    parts = records.where("number is not null").groupBy("origin").applyInArrow(join, _SEGMENT)
    whole = records.where("number is null").unionByName(parts)
    rows = whole.mapInArrow(decode, "page_id long, record_type string, refers_to long, digest string, payload binary, payload_bytes long")
    stated = F.regexp_extract("digest", "sha256:(.*)", 1)
    found = F.coalesce(F.sha2("payload", 256), stated)
    return rows.select("page_id", "record_type", "refers_to", "payload", "payload_bytes", found.alias("payload_digest"), (found == stated).alias("digest_ok"))


def whole(records: DataFrame) -> DataFrame:
    """The same records; one whose payload differs from its stated digest is an error."""
    damaged = F.raise_error(F.format_string("the payload of page %d differs from its digest", "page_id")).cast("string")
    return records.withColumn("payload_digest", F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(damaged))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return whole(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

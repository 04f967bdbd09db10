"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records, and ends with a skippable frame that lists the sizes of all frames (the
seek table of the public seekable format).  Any frame can be read by itself, and
the index maps a record to (bundle, frame, offset in the decompressed frame,
length).

Payloads of at least ``min_bytes`` that occur more than once are stored once: the
record of the largest page id is the response, the others are revisits that refer
to it.  Which record that is, is one aggregate over (digest, length); pages meet
it in a join on the digest, which Spark splits when one payload is very frequent.

Bundles are written by the tasks, under names of their own attempt, to the shared
folder; the index, written as a table, names only the bundles of the attempts that
succeeded, so a lost executor costs a rerun and leaves no half-read file.  Reading
starts from the seek tables and deals frames, not bundles, over the tasks.

Defined cases: a NULL payload is stored as an empty one; a NULL page id is kept as
``null`` in the record id and is never the largest; rows that repeat the largest
id are responses each; a NULL url leaves its header out; no pages give no bundles
and no rows; one page larger than a frame's target size gets a frame of its own.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path

# --- fixed values: the public formats ------------------------------------------
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")          # frames, descriptor, magic
ENTRY = struct.Struct("<III")           # compressed size, decompressed size, checksum
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# --- parameters -----------------------------------------------------------------
MIN_REVISIT_BYTES = 1000
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024         # of uncompressed records
# --------------------------------------------------------------------------------

INDEX_SCHEMA = "record_id string, page_id bigint, bundle string, frame int, `offset` bigint, length bigint"
FRAME_SCHEMA = "bundle string, frame int, start bigint, size bigint, plain_size bigint, checksum bigint"
RECORD_SCHEMA = ("record_id string, page_id bigint, url string, record_type string, refers_to bigint, "
                 "payload_digest string, payload_bytes bigint, payload binary")


# ------------------------------------------------------------------ one record
def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    tail = rid.rstrip(">").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def write_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has the HTTP head of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(data: bytes) -> Iterator[tuple]:
    """The records of a decompressed frame, as rows of RECORD_SCHEMA.  A response's
    payload must have the digest that its header states."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        field = _fields(data[at:end])
        size = int(field["content-length"])
        block = data[end + 4:end + 4 + size]
        at = end + 4 + size + 4
        http_head, _, payload = block.partition(b"\r\n\r\n")
        digest = field["warc-payload-digest"].removeprefix("sha1:")
        full = int(_fields(http_head)["content-length"])
        rid, kind = field["warc-record-id"], field["warc-type"]
        refers = page_of(field["warc-refers-to"]) if "warc-refers-to" in field else None
        if kind == "response":
            digest_read = hashlib.sha1(payload).hexdigest()
            if digest_read != digest or len(payload) != full:
                raise ValueError(f"record {rid}: the payload doesn't match its digest")
            digest = digest_read
        yield rid, page_of(rid), field.get("warc-target-uri"), kind, refers, digest, full, payload if kind == "response" else None


# ------------------------------------------------------------------ one bundle
class BundleWriter:
    """Collects records into frames and frames into a bundle file."""

    def __init__(self, uri: str, frame_bytes: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.uri, self.frame_bytes = uri, frame_bytes
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.pending, self.entries, self.plain = io.BytesIO(), [], 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """Returns the record's frame and offset."""
        if self.pending.tell() and self.pending.tell() + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.entries), self.pending.tell()
        self.pending.write(record)
        self.plain += len(record)
        return place

    def _flush(self) -> None:
        plain = self.pending.getvalue()
        frame = self.zstd.compress(plain)
        self.out.write(frame)
        self.entries.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending = io.BytesIO()

    def close(self) -> None:
        if self.pending.tell():
            self._flush()
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        foot = FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(foot)) + table + foot)
        self.out.close()


def read_seek_table(uri: str) -> list[tuple[int, int, int, int]]:
    """(start, size, plain size, checksum) of each frame of a bundle."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(f.size() - FOOTER.size)
        frames, descriptor, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not descriptor & CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table")
        f.seek(f.size() - FOOTER.size - frames * ENTRY.size)
        raw = f.read(frames * ENTRY.size)
    out, start = [], 0
    for size, plain, check in ENTRY.iter_unpack(raw):
        out.append((start, size, plain, check))
        start += size
    return out


def read_frame(uri: str, start: int, size: int, plain: int, checksum: int) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        data = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=plain)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError(f"{uri}: frame at {start} is damaged")
    return data


def read_record(index_row) -> tuple:
    """One record by its index row (random access: the seek table, one frame)."""
    frame = read_frame(index_row["bundle"], *read_seek_table(index_row["bundle"])[index_row["frame"]])
    at, n = index_row["offset"], index_row["length"]
    return next(read_records(frame[at:at + n]))


# ------------------------------------------------------------------ Spark
def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, ``refers_to`` (NULL: a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    first = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy(F.col("digest").alias("d"))
             .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "top"))
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= min_bytes), "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.withColumn("refers_to", F.when(other, F.col("top"))).drop("d", "top")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES,
                   frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles below ``folder`` (a shared
    URI) and return the index, one row per record."""
    rows = with_revisits(pages, min_bytes)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"{folder}/bundle-{ctx.stageId()}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        writer, made = None, 0
        for batch in batches:
            ids, urls, payloads, digests, refers = (batch.column(c) for c in range(5))
            index = []
            for k in range(batch.num_rows):
                if writer is None:
                    fs, path = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    writer = BundleWriter(f"{name}-{made:04d}.warc.zst", frame_bytes)
                    made += 1
                page_id = ids[k].as_py()
                record = write_record(page_id, urls[k].as_py(), payloads[k].as_py(), digests[k].as_py(), refers[k].as_py())
                frame, offset = writer.add(record)
                index.append((record_id(page_id), page_id, writer.uri, frame, offset, len(record)))
                if writer.plain >= bundle_bytes:
                    writer.close()
                    writer = None
            yield _batch(index, INDEX_ARROW)
        if writer is not None:
            writer.close()

    # materialised: the index names the bundles of the attempts that succeeded
    return materialize(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_archives(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """All records of ``bundles`` (column bundle): seek tables first, then frames."""

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(b, i, *e) for b in batch.column(0).to_pylist()
                          for i, e in enumerate(read_seek_table(b))], FRAME_ARROW)

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch(list(read_records(read_frame(b, *entry))), RECORD_ARROW)

    # frames are spread anew, so that a task reads few frames of many bundles
    dealt = bundles.select("bundle").mapInArrow(tables, FRAME_SCHEMA).repartition("bundle", "frame")
    return dealt.mapInArrow(frames, RECORD_SCHEMA)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return one row per page from
    what was read."""
    spark = pages.sparkSession
    index = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(spark, index.select("bundle").distinct()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _arrow(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl])


_I, _J, _S, _B = pa.int32(), pa.int64(), pa.string(), pa.binary()
INDEX_ARROW = _arrow([("record_id", _S), ("page_id", _J), ("bundle", _S), ("frame", _I), ("offset", _J), ("length", _J)])
FRAME_ARROW = _arrow([("bundle", _S), ("frame", _I), ("start", _J), ("size", _J), ("plain_size", _J), ("checksum", _J)])
RECORD_ARROW = _arrow([("record_id", _S), ("page_id", _J), ("url", _S), ("record_type", _S), ("refers_to", _J),
                       ("payload_digest", _S), ("payload_bytes", _J), ("payload", _B)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: DuckDB twin of ``archive_report``.
WARC_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages
), first AS (
  SELECT payload, max(page_id) AS top FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY payload
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN p.n < {MIN_REVISIT_BYTES} OR p.page_id = f.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.n >= {MIN_REVISIT_BYTES} AND p.page_id <> f.top THEN f.top END AS refers_to
FROM p LEFT JOIN first f ON p.payload = f.payload
"""

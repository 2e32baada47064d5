"""WARC archives in the shared folder: write with revisits, index first, read by coalesced byte ranges.

Each record is a gzip member of its own, so that any record can be read alone.  The writer returns an index row for
each record (archive, offset, length, URL, digest); the index is stored before anything is read back.  The
reader sorts the selected index rows by archive and offset and fetches neighbours with one range read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, input_parts, shared_dir, stored

#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Ranges of one archive are read together if so few bytes lie between them, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Smallest payload that a revisit may stand for.
MIN_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry no capture time of their own; a fixed date keeps repeated tasks' bytes equal.
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def header_value(value: str) -> str:
    """A header's value: control characters and percent signs are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def plain_value(value: str) -> str:
    out, at = [], 0
    while at < len(value):
        if value[at] == "%":
            out.append(chr(int(value[at + 1 : at + 3], 16)))
            at += 3
        else:
            out.append(value[at])
            at += 1
    return "".join(out)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record: a response with headers and payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def squeezed(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


INDEX = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def decide(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages as (page_id, url, html, record_type, refers_to): of equal payloads the largest page_id is the response.

    Payloads are told apart by SHA-256 and length.  A payload that many pages share is combined on the map side, and its
    decision is broadcast rather than shuffled to.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("body", F.unhex(F.sha2("html", 256)))
    keep = stored(rows.groupBy("body").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("size")), "warc-bodies")
    # Most payloads have one page; only the shared ones need a decision.
    shared = keep.filter(f"n > 1 AND size >= {min_bytes}").select("body", "keep", "n")
    found = hot_join(rows, stored(shared, "warc-shared"), ["body"], "n", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return found.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one or more .warc.gz files for each partition under folder; return the index, still to be stored.

    A task writes files under names of its own, so that a repeated or speculative attempt never touches another's; the
    index names those of the attempt that counted.
    """

    def run(batches):
        where, path = _filesystem(folder)
        where.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, kind, refers_to in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = sha1_base32(payload)
                    data = squeezed(record(page_id, url, payload, kind, refers_to, digest))
                    if out is None or at + len(data) > archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{path}/{name}", compression=None)
                        first = squeezed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
                        out.write(first)
                        at = len(first)
                    out.write(data)
                    rows.append((page_id, url, digest, kind, name, at, len(data)))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=INDEX.names)
        finally:
            if out is not None:
                out.close()

    return pages.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, INDEX)


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def coalesced(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES):
    """Cut rows (archive, offset, length), sorted, into reads: (archive, start, end, rows)."""
    group: list[tuple[str, int, int]] = []
    for r in rows:
        if group and (r[0] != group[0][0] or r[1] - (group[-1][1] + group[-1][2]) > gap or r[1] + r[2] - group[0][1] > most):
            yield group[0][0], group[0][1], group[-1][1] + group[-1][2], group
            group = []
        group.append(r)
    if group:
        yield group[0][0], group[0][1], group[-1][1] + group[-1][2], group


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records that index rows name, in archive order, with few range reads; check every digest."""
    schema = READ if with_payload else T.StructType(READ.fields[:-1])
    spots = selected.select("archive", "offset", "length", "payload_digest")
    parts = input_parts(selected.sparkSession)
    dealt = spots.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches):
        where, path = _filesystem(folder)
        opened: tuple[str, object] | None = None
        for batch in batches:
            digests = batch.column(3).to_pylist()
            spots = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            known, done = dict(zip(spots, digests, strict=True)), []
            for archive, start, end, group in coalesced(spots):
                if opened is None or opened[0] != archive:
                    if opened is not None:
                        opened[1].close()
                    opened = archive, where.open_input_file(f"{path}/{archive}")
                data = memoryview(opened[1].read_at(end - start, start))
                for spot in group:
                    r = parse(zlib.decompress(data[spot[1] - start : spot[1] - start + spot[2]], 31))
                    fields = r["fields"]
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if digest != known[spot] or kind == "response" and sha1_base32(r["payload"]) != digest:
                        raise ValueError(f"{archive} at {spot[1]}: the record's digest does not hold")
                    ident = lambda x: int(y) if (y := x.removeprefix("<urn:page:").removesuffix(">")) else None
                    url = fields.get("WARC-Target-URI")
                    done.append((ident(fields["WARC-Record-ID"]), None if url is None else plain_value(url), int(r["http"]["Content-Length"]), digest, kind, ident(fields["WARC-Refers-To"]) if kind == "revisit" else None, r["payload"] if kind == "response" else None)[: len(schema)])
            if done:
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=False)], names=schema.names)
        if opened is not None:
            opened[1].close()

    return dealt.mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT) -> tuple[str, DataFrame]:
    """(folder, index): archives of all pages, written, with their stored index."""
    folder = folder or shared_dir(spark, "warc")
    index = write_archives(decide(pages, min_bytes), folder)
    path = f"{folder}/index"
    index.write.parquet(path)
    return folder, spark.read.schema(INDEX).parquet(path)


def warc_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """One row per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null html is an empty payload; a null page_id is smaller than any other.  Rows that repeat the winning
    page_id are all responses.  Empty tables write no archive and give no rows.
    """
    spark = pages.sparkSession
    folder, index = archive_pages(spark, pages, None, min_bytes)
    return read_records(index, folder, with_payload=False)

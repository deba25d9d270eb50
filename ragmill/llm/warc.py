"""WARC archives: segmented writing with revisits, and reading with segment reassembly.

Method: a payload is sent in chunked transfer framing inside an HTTP response; a block over `segment` bytes is cut into
a first record and continuation records. Reading groups the records by the identifier of their origin, orders
them by segment number, verifies that numbers have no gap and that the length is the total that the last one states, and decodes the
chunked framing. Records are framed by their Content-Length alone, so payloads may hold anything.

Of records with equal payloads of at least `revisit_from` bytes, that with the largest page_id is a response and the
others revisit it, without a body; a reader takes length and digest of a revisited payload from the response.

Archives are files of Spark's text writer (records end with two line breaks), gzipped, with at most `per_file` records each, on
any file system that Spark writes. Each file is read by one task; segments of one record may lie in different files.

Defined cases: null html is an empty payload. Null page_id: left out. Repeated rows of a page_id are one page (of url and html
the greatest, as a pair). Line breaks in a url are percent-encoded; a null url is empty. Other columns are ignored. Records of which a
segment is missing, or whose length or framing is wrong, come back with complete = false and no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm._spark import fresh_path

SEGMENT, CHUNK, PER_FILE = 16 << 10, 4 << 10, 20_000
_URN = "urn:page:"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_: Column) -> Column:
    """Base32 of a 40-digit hexadecimal string."""
    groups = [F.conv(F.substring(hex_, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*(F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)))


def _chunked(payload: bytes, size: int) -> Iterator[bytes]:
    """Frames of the payload; cut between characters, as the writer takes text."""
    at = 0
    while at < len(payload):
        end = min(at + size, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end += 1
        yield b"%x\r\n%s\r\n" % (end - at, payload[at:end])
        at = end
    yield b"0\r\n\r\n"


def _records(page: int, url: str, payload: bytes, digest: str, refers: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    head = [b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode()]
    name = b"<%s%d>" % (_URN.encode(), page)
    if refers is not None:
        yield b"\r\n".join([b"WARC/1.1", b"WARC-Type: revisit", b"WARC-Record-ID: " + name, *head, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <%s%d>" % (_URN.encode(), refers), b"Content-Length: 0", b"", b""])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(_chunked(payload, chunk))
    parts, at = [], 0
    while at < len(block) or not parts:
        end = min(at + segment, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        parts.append(block[at:end])
        at = end
    for k, part in enumerate(parts, 1):
        own = [b"WARC-Type: response", b"WARC-Record-ID: " + name] if k == 1 else [b"WARC-Type: continuation", b"WARC-Record-ID: <%s%d:%d>" % (_URN.encode(), page, k), b"WARC-Segment-Origin-ID: " + name]
        number = [b"WARC-Segment-Number: %d" % k] if len(parts) > 1 else []
        total = [b"WARC-Segment-Total-Length: %d" % len(block)] if 1 < len(parts) == k else []
        yield b"\r\n".join([b"WARC/1.1", *own, *head, *number, *total, b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(part), b"", part])


def write(pages: DataFrame, path: str, revisit_from: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = PER_FILE) -> None:
    """Write a record (or several, if segmented) for each page."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    if rows.groupBy("page_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("page_id").agg(F.max(F.struct("url", "html")).alias("m")).select("page_id", "m.url", "m.html")
    rows = rows.withColumn("digest", base32(F.sha1("html")))
    slim = rows.where(F.octet_length("html") >= revisit_from).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").select("digest", "refers")
    known = slim.join(first, "digest").where("page_id <> refers").select("page_id", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page, url, html, digest, refers in zip(*batch.columns, strict=True):
                for r in _records(page.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers.as_py(), segment, chunk):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    records = rows.join(known, "page_id", "left").select("page_id", "url", "html", "digest", "refers").mapInArrow(run, "value string")
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive, read as a stream: one record is held at a time."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines that end a record
        head: dict[str, str] = {}
        while (line := stream.readline()) and line != b"\r\n":
            name, told, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            if told:
                head[name.lower()] = value
        yield head, stream.read(int(head.get("content-length", 0)))


def unchunked(block: bytes) -> bytes | None:
    """Payload of an HTTP response; None if the framing is broken."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None
    head, body = block[:end].lower(), block[end + 4 :]
    if b"transfer-encoding: chunked" not in head:
        return body
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or size and body[line + 2 + size : line + 4 + size] != b"\r\n":
            return None
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


_ROW = "origin string, type string, segment int, total long, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary, complete boolean"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_KINDS = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], _NAMES)


def _row(origin: str, kind: str, refers: str | None, said: str | None, block: bytes | None, keep: bool) -> tuple:
    payload = unchunked(block) if block is not None else None
    if payload is None:
        return origin, kind, None, None, refers, said, None, None, None, False
    return origin, kind, None, None, refers, said, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if keep else None, True


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """origin (record id), type, refers_to, digest (as stated), payload_bytes, payload_digest (as computed), payload, complete; one row for each record."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    number = head.get("warc-segment-number")
                    origin = head.get("warc-segment-origin-id") or head.get("warc-record-id", "")
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if head.get("warc-type") == "revisit":
                        rows.append((origin, "revisit", None, None, head.get("warc-refers-to"), said, None, None, None, True))
                    elif number is None:
                        rows.append(_row(origin, head.get("warc-type", ""), None, said, block, payloads))
                    else:
                        total = head.get("warc-segment-total-length")
                        rows.append((origin, head.get("warc-type", ""), int(number), total and int(total), None, said, None, None, block, None))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    def whole(rows: list[dict]) -> pa.RecordBatch:
        out = []
        for origin, group in itertools.groupby(rows, lambda r: r["origin"]):
            parts = list(group)
            total = next((r["total"] for r in parts if r["total"] is not None), None)
            block = b"".join(r["payload"] for r in parts)
            sound = [r["segment"] for r in parts] == list(range(1, len(parts) + 1)) and total == len(block)
            out.append(_row(origin, parts[0]["type"], None, parts[0]["digest"], block if sound else None, payloads))
        return _batch(out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # segments of the last origin, of which more may come
        for batch in batches:
            single = batch.column(2).is_null()
            yield batch.filter(single)
            held += batch.filter(pc.invert(single)).to_pylist()
            if held:
                last = held[-1]["origin"]
                yield whole([r for r in held if r["origin"] != last])
                held = [r for r in held if r["origin"] == last]
        yield whole(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInArrow(cut, _ROW)
    return rows.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(join, _ROW).drop("segment", "total")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of archives that `write` made."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
    rows = read(spark, path, payloads=False).where("complete").withColumn("page_id", number("origin")).withColumn("refers_to", number("refers_to"))
    kinds = rows.select("page_id", F.col("type").alias("record_type"), "refers_to", F.coalesce("payload_digest", "digest").alias("payload_digest"), "payload_bytes")
    # a response meets itself, so no key is null or shared by all responses
    kinds = kinds.withColumn("of", F.coalesce("refers_to", "page_id"))
    sizes = kinds.where("record_type = 'response'").select("of", F.col("payload_bytes").alias("of_response"))
    return kinds.join(sizes, "of", "left").select("page_id", F.coalesce("payload_bytes", "of_response").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to a fresh archive in the shared folder and read its digests."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return digests(pages.sparkSession, path)


ORACLE = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h) n, sha1(h) x, max(page_id) over (partition by h) top from p)
select page_id, n payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (5 * i) // 4 + 1, 2))::integer >> (3 - (5 * i) % 4)::integer) & 31), 1)), 'string_agg', '') payload_digest,
  case when page_id = top then 'response' else 'revisit' end record_type,
  case when page_id = top then null else top end refers_to from d
"""

"""Operator 9: web archives as a chunked record table.

A payload leaves and enters the archive as rows (record, chunk number, bytes).
Chunks after the first are ``continuation`` records of the WARC standard, in
order behind it, so writer and reader hold one chunk and a running digest,
never a whole payload.  Spark's text sink and source carry the files; no local
file is opened.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.storage import written

#: Largest payload part of one record.
CHUNK_BYTES = 64 << 10

#: Fixed values of the WARC standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_BATCH_BYTES = 4 << 20
_RECORD = "urn:page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def parts(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most ``size`` bytes, cut before a UTF-8 character where there is one; at least one piece."""
    begin = 0
    while True:
        end = min(begin + size, len(payload))
        cut = end
        while begin < cut < len(payload) and cut > end - 4 and payload[cut] & 0xC0 == 0x80:
            cut -= 1
        end = cut if cut > begin else end
        yield payload[begin:end]
        if end >= len(payload):
            return
        begin = end


def _head(kind: str, record: str, length: int, fields: dict[str, str]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"Content-Length: {length}"]
    return ("\r\n".join(lines + [f"{k}: {v}" for k, v in fields.items()]) + "\r\n\r\n").encode()


def _records(key: str, url: str | None, payload: memoryview | None, digest: str, size: int, refers_to: str | None,
             date: str, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, each without its last line feed, which the text sink writes."""
    common = {"WARC-Date": date, "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")}
    payload_digest = {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": str(size)}
    name = _RECORD + key
    if refers_to is not None:
        more = {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_RECORD}{refers_to}>"}
        yield _head("revisit", name, 0, common | payload_digest | more) + b"\r\n\r"
        return
    running, done = hashlib.sha1(), 0
    for number, part in enumerate(parts(payload, chunk_bytes), 1):
        running.update(part)
        done += len(part)
        last, cut = done == size, size > len(part)
        segment = {"WARC-Segment-Number": str(number), "WARC-Running-Digest": f"sha1:{base32(running.digest())}"} if cut else {}
        if number == 1:
            head = _head("response", name, len(HTTP_HEAD) + len(part),
                         common | payload_digest | segment | {"Content-Type": "application/http;msgtype=response"}) + HTTP_HEAD
        else:
            total = {"WARC-Segment-Total-Length": str(size + len(HTTP_HEAD))} if last else {}
            head = _head("continuation", f"{name}:{number}", len(part),
                         common | segment | {"WARC-Segment-Origin-ID": f"<{name}>"} | total)
        yield head + bytes(part) + b"\r\n\r"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= _BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _binaries(column: pa.Array) -> Iterator[memoryview | None]:
    for value in column:
        yield None if not value.is_valid else memoryview(value.as_buffer())


def payload_digests(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(page, bytes, sha1 hex) of every row; a null payload is empty.  Narrow."""
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    return pages.select(F.col(f"`{key}`").alias("page"), F.length(data).cast("long").alias("size"), F.sha1(data).alias("sha1"))


def originals(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(size, sha1, original): payloads of several records with the smallest page."""
    return (
        digests.filter(F.col("size") >= min_bytes).groupBy("size", "sha1")
        .agg(F.min("page").alias("original"), F.count(F.lit(1)).alias("records")).filter("records > 1").drop("records")
    )


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url",
               min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record per row as gzip files of WARC records.

    Of records with equal payloads of at least ``min_bytes`` bytes the smallest
    key is a ``response``, the others are ``revisit`` records without payload.
    A null payload is empty, a null url an empty URI; a null key is written as
    ``null`` and refers to the smallest key that is there.  Rows that repeat key
    and payload become a record each, of the same type.  An empty table gives no
    record.  Other columns are not read.

    The only wide shuffle deals rows to their dispositions by the digest; both
    sides are written or scanned, so adaptive execution splits a payload that
    holds a third of the records.
    """
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), data.alias("payload"),
        F.length(data).cast("long").alias("size"), F.sha1(data).alias("sha1"))
    # Decisions first, on narrow rows; payloads are dealt by page, which is unique.
    narrow = payload_digests(pages, key, payload)
    firsts = written(originals(narrow, min_bytes), "warc-originals")
    copies = written(
        narrow.join(firsts, ["size", "sha1"]).filter(~F.col("page").eqNullSafe(F.col("original")))
        .select("page", "sha1", "original").distinct(), "warc-copies").withColumnsRenamed({"page": "c_page", "sha1": "c_sha1"})
    rows = rows.join(copies, F.col("page").eqNullSafe(F.col("c_page")) & (F.col("sha1") == F.col("c_sha1")), "left").select(
        F.coalesce(F.col("page").cast("string"), F.lit("null")).alias("page"), "url",
        F.when(F.col("original").isNull(), F.col("payload")).alias("payload"), "size",
        F.unhex("sha1").alias("sha1"), F.col("original").cast("string").alias("original"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            info = b"software: dossier\r\nformat: WARC File Format 1.1\r\n"
            first = True
            for batch in batches:
                small = batch.drop_columns(["payload"]).to_pylist()
                for row, body in zip(small, _binaries(batch.column("payload"))):
                    if first:
                        yield (_head("warcinfo", "urn:dossier:warcinfo", len(info),
                                     {"WARC-Date": date, "Content-Type": "application/warc-fields"}) + info + b"\r\n\r",)
                        first = False
                    for record in _records(row["page"], row["url"], body, base32(row["sha1"]), row["size"],
                                           row["original"], date, chunk_bytes):
                        yield (record,)

        return _batches(records(), pa.schema([("value", pa.binary())]), lambda row: len(row[0]))

    rows.mapInArrow(render, "value binary").select(F.col("value").cast("string")).write.mode("append").option(
        "compression", "gzip").text(folder)


class _Reader:
    """Records of lines that come in order: bytes are passed on as they are read."""

    def __init__(self) -> None:
        self.head: list[bytes] | None = None
        self.left = 0
        self.body: list[bytes] = []
        self.page = self.kind = None

    def feed(self, line: bytes) -> Iterator[tuple]:
        """One line without its line feed; yields the chunk row that it completes."""
        if self.left:
            part = (line + b"\n")[:self.left]
            self.body.append(part)
            self.left -= len(part)
            if not self.left:
                yield from self.end()
        elif self.head is None:
            if line == VERSION.encode() + b"\r":
                self.head = []
            elif line != b"\r":
                raise ValueError(f"no record begins with {line[:40]!r}")
        elif line != b"\r":
            self.head.append(line.rstrip(b"\r"))
        else:
            self.fields = dict(x.decode().split(": ", 1) for x in self.head)
            self.head, self.body, self.left = None, [], int(self.fields["Content-Length"])
            if not self.left:
                yield from self.end()

    def end(self) -> Iterator[tuple]:
        fields, data, self.body = self.fields, b"".join(self.body), []
        kind = fields["WARC-Type"]
        name = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]).strip("<>")
        if kind == "warcinfo":
            return
        number = int(fields.get("WARC-Segment-Number", 1))
        if kind == "continuation":
            if name != self.page or number != self.number + 1:
                raise ValueError(f"chunk {number} of {name} does not follow its record")
        else:
            self.page, self.kind, self.first = name, kind, fields
            self.running, self.size = hashlib.sha1(), 0
            if kind == "response":
                data = data[data.index(b"\r\n\r\n") + 4:]
        self.number = number
        self.running.update(data)
        self.size += len(data)
        said = fields.get("WARC-Running-Digest", self.first["WARC-Payload-Digest"]).removeprefix("sha1:")
        last = "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields
        if self.kind == "response":
            running = base32(self.running.digest())
            if running != said or last and running != self.first["WARC-Payload-Digest"].removeprefix("sha1:"):
                raise ValueError(f"digest of {name}, chunk {number}: {running}, its record says {said}")
            size = self.size
        else:
            running, size = said, int(self.first["WARC-Payload-Length"])
        refers_to = self.first.get("WARC-Refers-To", "").strip("<>").removeprefix(_RECORD) or None
        yield (name.removeprefix(_RECORD), number, data, size, running, last, self.kind, refers_to, self.first["WARC-Target-URI"])


CHUNKS = pa.schema([
    ("page", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("size", pa.int64()), ("digest", pa.string()),
    ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string())])
CHUNK_COLUMNS = ("page string, chunk long, data binary, size long, digest string, last boolean, record_type string, "
                 "refers_to string, url string")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of ``write_warc`` as chunk rows (page, chunk, data, size, digest, last …).

    ``size`` and ``digest`` run over the chunks up to this one, so the row marked
    ``last`` has those of the payload.  A wrong digest is an error.  Gzip files
    are not split, so a task reads the records of a file in their order.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            reader = _Reader()
            for batch in batches:
                for line in _binaries(batch.column("value")):
                    yield from reader.feed(bytes(line or b""))

        return _batches(rows(), CHUNKS, lambda row: len(row[2]))

    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(parse, CHUNK_COLUMNS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record with the size and digest of its whole payload."""
    return chunks.filter("last").select("page", "size", "digest", "record_type", "refers_to", "url")

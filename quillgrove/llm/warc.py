"""WARC archives as a chunked record table.

A record is rows (record, chunk, data): its bytes in order, cut into chunks. Each row also carries
the digest of the payload up to its end. Rows are written and read one after the other, so no task
holds a whole record beside the value that it came from.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrove.llm.store import keyed, named, stored, text_bytes

CHUNK = 1 << 16
#: Payloads of fewer bytes are written in full wherever they occur.
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BATCH = 4 << 20


def record_name(page_id: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}").urn


def heads(page_id: int, url: str | None, payload_bytes: int, sha1: str, refers_to: int | None) -> bytes:
    """A record's WARC header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    target = "".join(c for c in (url or "urn:none") if c.isprintable())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_name(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_name(refers_to)}>", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    length = len(http) + (payload_bytes if refers_to is None else 0)
    lines += [f"X-Page: {page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http


def chunks_of(head: bytes, payload: memoryview, chunk: int = CHUNK) -> Iterator[tuple[bytes, str]]:
    """A record's bytes in chunks, each with the SHA-1 of the payload up to its end."""
    digest = hashlib.sha1()
    begin = max(0, chunk - len(head))
    first = payload[:begin]
    digest.update(first)
    end = b"\r\n\r\n"
    held = head + bytes(first)
    while begin < len(payload):
        yield held, digest.hexdigest()
        part = payload[begin : begin + chunk]
        digest.update(part)
        held, begin = bytes(part), begin + chunk
    yield held + end, digest.hexdigest()


class Parser:
    """Reads a record from its chunks in order. It holds the header and one chunk, never the payload."""

    def __init__(self) -> None:
        self.held, self.fields, self.left, self.digest, self.bytes = b"", None, 0, hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.held += data
            end = self.held.find(b"\r\n\r\n")
            http_end = self.held.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if http_end < 0:
                return
            if not self.held.startswith(b"WARC/1."):
                raise ValueError("not a WARC record")
            lines = self.held[:end].decode().split("\r\n")[1:]
            self.fields = dict(x.split(": ", 1) for x in lines)
            http = self.held[end + 4 : http_end].decode().split("\r\n")[1:]
            self.fields["http-length"] = dict(x.split(": ", 1) for x in http)["Content-Length"]
            self.left = int(self.fields["Content-Length"]) - (http_end + 4 - end - 4)
            data, self.held = self.held[http_end + 4 :], b""
        part = data[: self.left]
        self.digest.update(part)
        self.bytes += len(part)
        self.left -= len(part)

    def row(self) -> tuple[int, int, str, str, int | None]:
        """page_id, payload_bytes, payload_digest, record_type, refers_to; raises on what was damaged."""
        if self.fields is None or self.left:
            raise ValueError("the record is cut short")
        kind, full = self.fields["WARC-Type"], int(self.fields["http-length"])
        sha1 = base64.b32decode(self.fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if kind == "response" and (self.digest.hexdigest() != sha1 or self.bytes != full):
            raise ValueError(f"payload of {self.fields['WARC-Record-ID']} differs from its digest")
        refers = self.fields.get("X-Refers-To-Page")
        return int(self.fields["X-Page"]), full, sha1, kind, int(refers) if refers else None


def typed(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, sha1 and refers_to to pages(page_id, url, html).

    Of equal payloads of at least LEAST bytes, the one of the largest page_id is the response. Rows
    that repeat this page_id are responses too.
    """
    body = text_bytes("html")
    own = pages.withColumn("payload_bytes", F.length(body).cast("long")).withColumn("sha1", F.sha1(body))
    most = own.where(F.col("payload_bytes") >= LEAST).groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = own.select("page_id", "url", "payload_bytes", "sha1", "html").join(stored(most, "responses"), ["sha1", "payload_bytes"], "left")
    return met.withColumn("refers_to", F.when(F.col("last") != F.col("page_id"), F.col("last"))).drop("last")


def write(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of pages(page_id, url, html): record, page_id, row, chunk, data, sha1_so_far.

    `row` tells records of a repeated page_id apart. Null html is an empty payload. A chunk has `size`
    bytes at most, but for the first, which holds the whole header, and the line ends after the last.
    """
    rows = typed(pages).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["record", "page_id", "row", "chunk", "data", "sha1_so_far"])
            held.clear()
            return made

        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "sha1", "refers_to", "row")]
            bodies = batch.column("html").cast(pa.large_binary())
            for *row, body in zip(*fields, bodies, strict=True):
                page, url, n, sha1, refers, key = row
                payload = memoryview(body.as_buffer()) if body.is_valid and refers is None else memoryview(b"")
                for k, (data, so_far) in enumerate(chunks_of(heads(page, url, n, sha1, refers), payload, size)):
                    held.append((record_name(page), page, key, k, data, so_far))
                    waiting += len(data)
                    if waiting > BATCH:
                        yield out()
                        waiting = 0
        if held:
            yield out()

    return stored(rows.select("page_id", "url", "html", "payload_bytes", "sha1", "refers_to", "row").mapInArrow(run, "record string, page_id long, row long, chunk int, data binary, sha1_so_far string"), "archive")


def read(chunks: DataFrame) -> DataFrame:
    """Records of a chunked record table: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are digested again, chunk by chunk, and compared with what was written.
    """
    ordered = chunks.select("row", "chunk", "data", "sha1_so_far").repartition("row").sortWithinPartitions("row", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        now, key, done = None, None, []
        for batch in batches:
            for row, chunk, data, so_far in zip(*(batch.column(k) for k in range(4)), strict=True):
                if row.as_py() != key:
                    if now:
                        done.append(now.row())
                    now, key, expected = Parser(), row.as_py(), 0
                if chunk.as_py() != expected:
                    raise ValueError("a chunk is missing")
                expected += 1
                now.feed(data.as_py())
                if now.fields and now.fields["WARC-Type"] == "response" and now.digest.hexdigest() != so_far.as_py():
                    raise ValueError("a chunk differs from its digest")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=NAMES)
                done = []
        if now:
            done.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=NAMES)

    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def as_stream(rows: Iterable) -> bytes:
    """The archive that rows of a chunked record table make, as one WARC file's bytes (for small ones)."""
    return b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: (r.row, r.chunk)))


def round_trip(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Writes pages(page_id, url, html) and reads the archive back. Every row is a record, an empty table none.

    A null html is an empty payload; a null page_id stays null, a null url is written as none; repeated
    rows are records each; other columns are not looked at.
    """
    read_back = read(write(keyed(pages, "page_id"), size))
    return named(named(read_back, "page_id"), "refers_to")

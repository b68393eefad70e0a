"""Response records of WARC files, framed by their lengths.

A file is read as bytes, one task a file (Spark's binary reader holds at most
2 GB of it); inside the task it is unpacked and cut record by record, so what is
held besides is one record.  A record's block is as long as Content-Length says,
whatever stands in it.  The HTTP body is taken out of its transfer chunks and
content encoding and decoded by the charset of its header, its own ``meta``
element, or else as UTF-8.  The payload digest is the record's own, or that of
the body's bytes as they were sent, chunks joined.

Defined cases: files may be plain, one gzip stream, or a member for each record;
a file cut short gives the whole records before the cut; a record without a
Content-Length ends the reading of its file; a body that can't be unpacked, or
chunks that don't add up, are kept as they are; undecodable bytes become U+FFFD;
other record types are skipped; an empty file gives none.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "page_id long, record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string"
CHUNK = 1 << 20
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def unpacked(data: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces, unpacked if it is gzip of one or many members."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + CHUNK] for at in range(0, len(data), CHUNK))
        return
    at, stream = 0, zlib.decompressobj(31)
    try:
        while at < len(data) or stream.unconsumed_tail:
            piece = stream.unconsumed_tail or data[at : at + CHUNK]
            at += 0 if stream.unconsumed_tail else CHUNK
            yield stream.decompress(piece, CHUNK)
            if stream.eof:
                rest = stream.unused_data
                at = min(at, len(data)) - len(rest)
                while data[at : at + 1] == b"\0":  # padding between members
                    at += 1
                stream = zlib.decompressobj(31)
    except zlib.error:  # cut short or damaged: what came before stands
        return


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each whole record."""
    held = bytearray()

    def fill(size: int) -> bool:
        for piece in pieces:
            held.extend(piece)
            if len(held) >= size:
                return True
        return len(held) >= size

    while True:
        while True:  # the line ends before a record
            skip = len(held) - len(held.lstrip(b"\r\n"))
            del held[:skip]
            if held or not fill(1):
                break
        head, size = _HEAD_END.search(held), len(held)
        while head is None and fill(size + 1):
            head, size = _HEAD_END.search(held, max(0, size - 4)), len(held)
        if head is None:
            return
        lines = bytes(held[: head.start()]).decode("utf-8", "replace").splitlines()
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        length = fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdigit() or not fill(head.end() + int(length)):
            return
        end = head.end() + int(length)
        yield fields, bytes(held[head.end() : end])
        del held[:end]


def unchunked(body: bytes) -> bytes:
    """The body out of its transfer chunks; as it is if they don't add up."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n > len(body):
            return body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded_content(body: bytes, encoding: str) -> bytes:
    for name in reversed([e.strip().lower() for e in encoding.split(",") if e.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif name == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
        except (OSError, EOFError, zlib.error):
            return body
    return body


def as_text(body: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type.encode("latin-1", "replace")) or _CHARSET.search(body[:2048])
    name = named[1].decode("ascii") if named else "utf-8"
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def response_of(fields: dict[str, str], block: bytes) -> tuple:
    """One row of ``SCHEMA``."""
    end = _HEAD_END.search(block)
    head, sent = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    text = head.decode("utf-8", "replace")
    http = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in text.splitlines()[1:])}
    body = unchunked(sent) if "chunked" in http.get("transfer-encoding", "").lower() else sent
    own = fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
    payload = as_text(decoded_content(body, http.get("content-encoding", "")), http.get("content-type", ""))
    return None, fields.get("warc-record-id"), fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date"), text, payload, own


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at a path, as ``warc.responses`` gives those of pages; page_id is null."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records(unpacked(content.as_py())):
                    if fields.get("warc-type", "").lower() != "response":
                        continue
                    rows.append(response_of(fields, block))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 1024:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] + [pa.string()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)

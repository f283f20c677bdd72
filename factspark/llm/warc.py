"""WARC archives: monolithic gzip files normalised to one gzip member for each record, with a sidecar offset index.

Each partition first writes its records as one gzip stream. The normaliser inflates that stream once, from start to end, and
rewrites every record as its own member; the index (one JSON line for each record: offset, length, type, id) lets a reader
fetch any record alone. Memory is bounded by one chunk and one record header, not by record or file.

Of pages with equal payloads the one with the smallest id is the response and the others are revisits of it. Null html is an
empty payload; a null id is always a response with a null id; rows that repeat the smallest id of a payload are all
responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK = 1 << 16
#: Bytes of records after which a partition starts its next archive.
ROLL_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def record(page: int | None, url: str | None, html: bytes, first: int | None, unique: str) -> bytes:
    """One record; a revisit if first is another page's id."""
    name = f"<urn:page:{page}>" if page is not None else f"<urn:page:none:{unique}>"
    revisit = first is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if revisit else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(html).digest()).decode()}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(read) -> Iterator[bytes]:
    """What a gzip file of any number of members holds, in chunks; read(n) gives its next bytes."""
    unzip, data = zlib.decompressobj(31), read(CHUNK)
    while data:
        out = unzip.decompress(data, CHUNK)
        if out:
            yield out
        data = unzip.unconsumed_tail or unzip.unused_data
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        data = data or read(CHUNK)


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def normalise(read, write, level: int = 4) -> list[dict]:
    """Rewrites the records of a gzip stream as a member each; the index, a dict for each record in file order."""
    index: list[dict] = []
    at, held = 0, b""
    source = inflated(read)

    def more() -> bool:
        nonlocal held
        got = next(source, None)
        held += got or b""
        return got is not None

    while True:
        while not held and more():
            pass
        if not held:
            return index
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("the last record has no whole header")
        fields = headers(held[:end])
        left = end + 4 + int(fields["content-length"]) + 4
        gz, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        while left:
            while not held:
                if not more():
                    raise ValueError("the last record is cut off")
            part, held = held[:left], held[left:]
            left -= len(part)
            if out := gz.compress(part):
                write(out)
                size += len(out)
        out = gz.flush()
        write(out)
        size += len(out)
        index.append({"offset": at, "length": size, "type": fields["warc-type"], "id": fields["warc-record-id"]})
        at += size


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first: the id of the page that this one repeats, null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("same"))
    firsts = rows.where(F.octet_length("html") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"))
    first = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return rows.join(firsts, "same", "left").select("page_id", "url", "html", first.alias("first"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 4) -> DataFrame:
    """Writes folder/*.warc.gz and folder/*.warc.gz.idx; returns one row for each archive: path, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, raw, gz, size = TaskContext.get().partitionId(), 0, None, None, 0

        def finish() -> pa.RecordBatch:
            raw.write(gz.flush())
            raw.close()
            out = C.AtomicFile(path := raw_path.removesuffix(".raw"))
            with raw.fs.open_input_stream(raw.path, compression=None) as source:
                index = normalise(source.read, out.write, level)
            out.close()
            side = C.AtomicFile(path + ".idx")
            side.write("".join(json.dumps(x) + "\n" for x in index).encode())
            side.close()
            raw.fs.delete_file(raw.path)
            return pa.record_batch([[path], [len(index)]], ["path", "records"])

        for b in C.slices(batches, "html"):
            buf, off = C.raw(b.column("html"))
            data = buf.tobytes()
            for i, (page, url, first) in enumerate(zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("first").to_pylist(), strict=True)):
                if raw is None:
                    raw_path = f"{folder}/{task:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.warc.gz.raw"
                    raw, gz, size = C.AtomicFile(raw_path), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                made = record(page, url, data[off[i] : off[i + 1]], first, f"{task}-{number}-{size}")
                raw.write(gz.compress(made))
                size += len(made)
                if size >= ROLL_BYTES:
                    yield finish()
                    raw, number = None, number + 1
        if raw is not None:
            yield finish()

    return C.staged(mark_revisits(pages, min_bytes).mapInArrow(C.tidied(write), "path string, records long"), folder, "manifest")


def page_of(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def parse(data: bytes) -> tuple:
    """What a record says of its page, as a row of ROW; a response's length and digest are taken from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri")


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record of an archive, found by its index entry."""
    fs, at = C.filesystem(path)
    with fs.open_input_file(at) as f:
        return zlib.decompress(f.read_at(length, offset), 31)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = C.filesystem(path)
                with fs.open_input_stream(at + ".idx", compression=None) as side, fs.open_input_file(at) as f:
                    for lines in C.chunks(side.read().decode().splitlines(), 1000):
                        rows = [parse(zlib.decompress(f.read_at(x["length"], x["offset"]), 31)) for x in map(json.loads, lines)]
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(C.tidied(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
x AS (SELECT p.*, first, sha1(h) AS s FROM p JOIN f USING (h)),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(s, i, 1)) - 3, 4)), '') AS bits FROM x)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * g + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM b
"""

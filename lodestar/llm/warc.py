"""WARC archives with an index first.

Every task writes the records of its rows, each a gzip member of its own, into files of at most FILE_BYTES in the shared
folder, and returns one index row for each record: file, offset, length, URL and digest. The index is the authority: a
file's name holds a fresh id, so what a lost or repeated attempt wrote is never referred to. Reading sorts the selected
index rows by file and offset, joins ranges that are at most GAP bytes apart (up to RANGE_BYTES), and fetches each such
range once.

Of records with equal payloads (by SHA-256) of at least `min_bytes` bytes the one with the largest page_id is the
response, all others are revisits that refer to it.

Edge cases: null html is an empty payload; a null url is empty; repeated rows with the largest page_id are all
responses; a row with null page_id refers to the largest page_id of its payload, or is a response if all are null; an
empty table gives an empty index and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import qualified, read, shared_dir, stage_table, through_python

MIN_BYTES, FILE_BYTES, GAP, RANGE_BYTES, LEVEL = 0, 1 << 30, 1 << 16, 8 << 20, 3
#: Bytes of archive that a task reads, where that gives every core a task.
READ_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, digest: str, payload: bytes | None, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record as plain bytes: a response, or without payload a revisit."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(body)),
    }
    if payload is None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A record's page_id, url, type, refers_to, digest and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's end is not where its length says")
    number = lambda x: int(m[1]) if (m := re.search(r":(-?\d+)>", x or "")) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, number(fields.get("WARC-Refers-To")), digest, payload


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    out, name, at = None, "", 0
    try:
        for b in batches:
            rows = []
            for page_id, url, html, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "first")), strict=True):
                page_id, url, first, payload = page_id.as_py(), url.as_py() or "", first.as_py(), html.as_py() or b""
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                digest, own = payload_digest(payload), page_id == first
                raw = _member(record(page_id, url, digest, payload if own else None, first))
                out.write(raw)
                rows.append((f"{folder}/{name}", at, len(raw), page_id, url, digest, "response" if own else "revisit"))
                at += len(raw)
            if rows:
                f, o, n, p, u, d, k = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(u), pa.array(d), pa.array(k)], names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
    finally:
        if out:
            out.close()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives below `folder` (a path or URI that all executors share); returns their index."""
    folder = qualified(pages.sparkSession, folder)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    alone = F.octet_length("html") < min_bytes
    pages = pages.withColumn("same", F.sha2("html", 256))
    top = stage_table(pages.filter(~alone).groupBy("same").agg(F.max("page_id").alias("top")), "warc-responses", whole=True)  # read anew, so that the join can split a very common payload
    rows = pages.join(top, "same", "left").withColumn("first", F.when(alone, F.col("page_id")).otherwise(F.col("top"))).drop("same", "top")
    return stage_table(through_python(rows, lambda it: _write(it, folder), INDEX), "warc-index", whole=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[str, int, int]]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)

    def ranges() -> Iterator[tuple[str, list[tuple[int, int]]]]:
        name, held = None, []
        for file, at, n in rows():
            if held and (file != name or at - sum(held[-1]) > GAP or at + n - held[0][0] > RANGE_BYTES):
                yield name, held
                held = []
            name = file
            held.append((at, n))
        if held:
            yield name, held

    files: dict[str, object] = {}
    for name, held in ranges():
        if name not in files:
            for f in files.values():
                f.close()
            fs, path = pyarrow.fs.FileSystem.from_uri(name)
            files = {name: fs.open_input_file(path)}
        start = held[0][0]
        raw = files[name].read_at(sum(held[-1]) - start, start)
        found = [parse(zlib.decompress(raw[at - start : at - start + n], 31)) for at, n in held]
        p, u, k, r, d, x = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(u, pa.string()), pa.array(k, pa.string()), pa.array(r, pa.int64()), pa.array(d, pa.string()), pa.array(x, pa.binary())], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])


def read_archives(index: DataFrame) -> DataFrame:
    """The records of the index rows given (any selection), checked against their digests; tasks have a like number of rows."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return through_python(index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset"), _read, RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = stage_table(read_archives(index).select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-records", whole=True)
    full = found.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("bytes").alias("full_bytes"))
    full = stage_table(full, "warc-sizes", whole=True)  # read anew, so that the join can split a response that many refer to
    revisits = found.filter("record_type = 'revisit'").join(full, "refers_to", "left").withColumn("bytes", F.col("full_bytes"))
    both = found.filter("record_type = 'response'").unionByName(revisits.drop("full_bytes"))
    return both.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS h FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM s
"""

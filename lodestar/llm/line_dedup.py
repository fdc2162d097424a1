"""Line deduplication over all documents.

Every line key is known by 128 bits of its SHA-256. Keys are dealt out by the range of their first 64 bits; each range has
two Bloom filters of its own, of bits that were set once and bits that were set twice, sized by the keys that fall there:
a key whose bits are all set already goes to the second filter. Only keys with all their bits in the second filter are
suspected repeats; those shuffle by key, are confirmed exactly, and the smallest doc_id of each wins. So a filter is as
large as a task's share of the input, whatever the input's size, and nothing is collected or broadcast.

A key that several documents of one batch hold is known to repeat: its rows skip the filters, and one row stands for them
in its range, so that a very common line brings a range a row for each batch at most.

A key is the line without ASCII white space at both ends, A-Z lower-cased; keys under MIN_CHARS code points always stay.

Edge cases: a null or empty text is one empty line; rows that share a doc_id count as one document; a null doc_id takes
no part (its lines stay and count for nobody); an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import BitFilter, power_of_two, read, stage_table, through_python

MIN_CHARS = 10
SPACE = " \t\n\x0b\x0c\r"
#: Bits of each filter for a key that its range has.
BITS_PER_KEY, LEAST_BITS, HASHES = 16, 1 << 10, 3
#: What a row says: a key to be filtered, a key that is known to repeat, or the one that stands for such a key in its range.
OPEN, KNOWN, STANDS = 0, 1, 2
_UPPER = bytes(range(65, 91))
_LOWER = _UPPER.lower()
_TABLE = bytes.maketrans(_UPPER, _LOWER)


def keys(text: str | None) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        line = line.strip(SPACE)
        out.append(line.encode("utf-8", "surrogatepass").translate(_TABLE) if len(line) >= MIN_CHARS else None)
    return out


def _key(k: bytes) -> bytes:
    return hashlib.sha256(k).digest()[:16]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different key of a document: the key's two halves, the document, and what the batch knows of it."""
    for batch in batches:
        keyed: list[bytes] = []
        ids: list[int] = []
        docs: dict[int, set[bytes]] = {}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if doc_id is not None:
                docs.setdefault(doc_id, set()).update(_key(k) for k in set(keys(text.as_py())) if k is not None)
        for doc_id, found in docs.items():
            keyed += found
            ids += [doc_id] * len(found)
        often = Counter(keyed)
        kinds = [OPEN if often[k] == 1 else KNOWN for k in keyed]
        for k in (k for k, n in often.items() if n > 1):
            keyed.append(k)
            ids.append(0)
            kinds.append(STANDS)
        h, rest = np.frombuffer(b"".join(keyed), np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rest), pa.array(ids, pa.int64()), pa.array(kinds, pa.int8())], names=["h", "rest", "doc_id", "kind"])


def twice(h: np.ndarray) -> BitFilter:
    """The filter of the hashes that stand at two places at least, and of few others."""
    n_bits = power_of_two(len(h) * BITS_PER_KEY, LEAST_BITS, 1 << 62)
    once, again = np.zeros(n_bits, bool), np.zeros(n_bits, bool)
    places = np.stack([p.astype(np.int64) for p in BitFilter.places(h, n_bits, HASHES)]) if len(h) else np.zeros((HASHES, 0), np.int64)
    for at in range(0, len(h), 1 << 14):
        # a hash has each of its bits once; counts tell which bits were set before
        found, n = np.unique(np.sort(places[:, at : at + (1 << 14)], axis=0).ravel(), return_counts=True)
        again[found[(n > 1) | once[found]]] = True
        once[found] = True
    return BitFilter(np.packbits(again, bitorder="little"), HASHES)


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known to repeat, and of a range's other keys those that its second filter has."""
    held = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        yield batch.filter(pa.array(kind == KNOWN)).select(["h", "rest", "doc_id"])
        held.append(batch.filter(pa.array(kind != KNOWN)))
    if held:
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy().view(np.uint64)
        hit = twice(h).has(h) & (table.column("kind").to_numpy() == OPEN)
        yield from table.filter(pa.array(hit)).select(["h", "rest", "doc_id"]).combine_chunks().to_batches()


def suspected(docs: DataFrame) -> DataFrame:
    """h, rest, doc_id: keys that may repeat, among them all that do."""
    rows = through_python(docs.select("doc_id", "text"), _keyed, "h long, rest long, doc_id long, kind byte")
    # rows that pass the filters by are spread by their document
    rows = rows.repartition(F.when(F.col("kind") == KNOWN, F.xxhash64("doc_id", "rest")).otherwise(F.col("h")))
    return through_python(rows, _filtered, "h long, rest long, doc_id long")


def _drop(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, totals, dropped = [], [], []
        for text, gone in zip(batch.column("text"), batch.column("__gone"), strict=True):
            text, gone = text.as_py(), {g["h"].to_bytes(8, "little", signed=True) + g["rest"].to_bytes(8, "little", signed=True) for g in gone.as_py() or ()}
            lines = (text or "").split("\n")
            kept = [line for line, k in zip(lines, keys(text), strict=True) if k is None or _key(k) not in gone] if gone else lines
            texts.append("\n".join(kept))
            totals.append(len(lines))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c != "text"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=[*(c for c in names if c != "text"), "text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, keep: list[str] = ("doc_id", "text")) -> DataFrame:
    """The documents (columns `keep`) with repeated lines taken out of `text`, and n_lines, n_dropped."""
    names, key = list(keep), ["h", "rest"]
    docs = docs.select(*names).withColumn("doc_id", F.col("doc_id").cast("long"))
    suspects = stage_table(suspected(docs), "line-suspects", whole=True)
    first = suspects.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    first = stage_table(first, "line-firsts", whole=True)  # read anew, so that the join can split a very common line
    gone = suspects.join(first, key).filter("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct(*key)).alias("__gone"))
    gone = gone.withColumnRenamed("doc_id", "__doc")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return through_python(docs.join(gone, docs["doc_id"] == gone["__doc"], "left").drop("__doc"), lambda it: _drop(it, names), f"{fields}, text string, n_lines long, n_dropped long")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (doc_id > first))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR doc_id <= first), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k) GROUP BY doc_id
"""

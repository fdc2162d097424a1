"""Benchmark decontamination by winnowing.

Words are hashed straight from the UTF-8 bytes. Of every window of WINDOW words the smallest K-gram hash is its
fingerprint, so a shared window always shares its fingerprint. Training windows whose fingerprint is in a Bloom filter
of the benchmark's (of bounded size, made on the executors) are extended to their whole text, and the equality join on
that text with the benchmark's windows decides. Items of fewer than WINDOW words are one window of their own length,
looked up at every position. The benchmark may have any size: its windows take part in a shuffle join, and of the
documents only suspected windows, counts and ids move; no text of theirs is shuffled.

Edge cases: null and empty texts have no words; items without words match nothing; equal items all count; every
row of the documents is one of its own, whether its doc_id is null, repeated or neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import Rolling, blocks, collected_filter, mixed, power_of_two, read, stage_table, through_python

WINDOW, K = 10, 5
#: Bits of the filter for each benchmark fingerprint, and at most (16 MB).
BITS_PER_PRINT, MOST_BITS = 32, 1 << 27
_ROLL = Rolling()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_GRAM = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of several documents: lower-cased bytes, the ends of each word, its hash and its document."""

    def __init__(self, off: np.ndarray, data: np.ndarray) -> None:
        self.data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD[data]
        cut = np.zeros(len(data) + 2, bool)
        cut[off + 1] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:])) + 1
        self.hash = _ROLL.ranges(_ROLL.prefix(self.data), self.start, self.end)
        self.first = np.searchsorted(self.start, off)  # the first word of each document, and one more
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def grams(self, k: int) -> np.ndarray:
        """A hash of every k words in a row, across documents too."""
        n = len(self.hash) - k + 1
        out = np.zeros(max(0, n), np.uint64)
        for i in range(k if n > 0 else 0):
            out = out * _GRAM + self.hash[i : i + n]
        return mixed(out) + np.uint64(k)

    def whole(self, k: int) -> np.ndarray:
        """The starts at which k words lie in one document."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def prints(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows, and each one's fingerprint: the least of its k-gram hashes."""
        starts, grams = self.whole(window), self.grams(k)
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        n = len(grams) - (window - k)
        least = grams[:n].copy()
        for i in range(1, window - k + 1):
            np.minimum(least, grams[i : i + n], out=least)
        return starts, least[starts]

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[at : at + k].tolist(), self.end[at : at + k].tolist(), strict=True)).decode("utf-8", "replace")


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for part, off, data in blocks(batches):
        words, ids = Words(off, data), part.column("item_id").to_pylist()
        rows = [(ids[words.doc[a]], words.text(a, window), int(p), window) for a, p in zip(*(x.tolist() for x in words.prints(window, k)), strict=True)]
        for i, n in enumerate(np.diff(words.first).tolist()):
            if 0 < n < window:
                at = int(words.first[i])
                rows.append((ids[i], words.text(at, n), int(words.grams(n)[at]), n))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(np.array(cols[2], np.uint64).view(np.int64)), pa.array(cols[3], pa.int32())], names=["item_id", "win", "print", "width"])


def _hits(batches: Iterator[pa.RecordBatch], held, widths: list[int], window: int, k: int) -> Iterator[pa.RecordBatch]:
    test = held.value
    for part, off, data in blocks(batches):
        words, ids, keys = Words(off, data), part.column("doc_id").to_pylist(), part.column("__row").to_pylist()
        found = []
        for width in widths:
            if width == window:
                starts, prints = words.prints(window, k)
            else:
                starts = words.whole(width)
                prints = words.grams(width)[starts]
            found += [(a, width) for a in starts[test.has(prints)].tolist()]
        n = np.diff(words.first).tolist()
        base = words.first.tolist()
        docs = words.doc
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys + [keys[docs[a]] for a, _ in found], pa.int64()),
                pa.array(ids + [ids[docs[a]] for a, _ in found], pa.int64()),
                pa.array([None] * len(ids) + [words.text(a, w) for a, w in found], pa.string()),
                pa.array([0] * len(ids) + [a - base[docs[a]] for a, _ in found], pa.int64()),
                pa.array([0] * len(ids) + [w for _, w in found], pa.int32()),
                pa.array(n + [0] * len(found), pa.int64()),
            ],
            names=["__row", "doc_id", "win", "at", "width", "n_words"],
        )


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_hit, spans = [], []
        for hits in b.column("hits").to_pylist():
            runs: list[list[int]] = []
            for at, width in sorted((h["at"], h["width"]) for h in hits or ()):
                if runs and at <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], at + width)
                else:
                    runs.append([at, at + width])
            n_hit.append(sum(e - a for a, e in runs))
            spans.append([{"start": a, "end": e} for a, e in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), b.column("items"), pa.array(spans, kind)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings), spans (of words, maximal) for each document."""
    spark = docs.sparkSession
    tests = stage_table(through_python(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), lambda it: _item_windows(it, window, k), "item_id long, win string, print long, width int"), "test-windows")
    head = tests.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("w")).first()
    widths, n_bits = sorted(head["w"]), power_of_two(head["n"] * BITS_PER_PRINT, 1 << 12, MOST_BITS)
    held = spark.sparkContext.broadcast(collected_filter(tests.select(F.col("print").alias("h")), n_bits))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("__row"))
    found = stage_table(through_python(rows, lambda it: _hits(it, held, widths, window, k), "__row long, doc_id long, win string, at long, width int, n_words long"), "doc-windows", whole=True)
    # both are read anew, so that the joins can split a window that very many documents hold
    wins = stage_table(tests.select("win").distinct(), "test-texts")
    items = stage_table(tests.select("win", F.col("item_id").cast("string").alias("item")).distinct(), "test-items")
    hits = stage_table(found.filter("win is not null").join(wins, "win", "left_semi").select("__row", "win", "at", "width"), "doc-hits", whole=True)
    of = hits.select("__row", "win").distinct().join(items, "win").groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = hits.groupBy("__row").agg(F.collect_list(F.struct("at", "width")).alias("hits"))
    per = found.filter("win is null").select("__row", "doc_id", "n_words").join(spans.join(of, "__row", "left"), "__row", "left")
    per = per.select("doc_id", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return through_python(per, _covered, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS win FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Packing of tokenized documents into fixed windows, by best-fit decreasing.

A segment tree indexed by remaining capacity finds the tightest open window that still takes a piece. Documents longer
than a window are first cut into full windows; only their rests compete for space. Each partition packs by itself, in
blocks of at most BLOCK_PIECES pieces, so nothing but lengths is held and no text is shuffled; a window is never shared
between partitions, which costs at most a few part-filled windows for each block.

Edge cases: null and empty texts are documents of the separator alone; repeated rows are packed once each; null doc_id
is carried through; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import blocks, read, through_python

WINDOW = 1024
SEPARATOR = 0
BLOCK_PIECES = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Beyond these code points the two libraries' Unicode tables might differ, so such texts go to `tokenizers` itself.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")


class CapacityTree:
    """For each remaining capacity 0..size the open windows that have it; finds the least capacity >= n in O(log size)."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest window with room for `least`, or None."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length (1..size), and the number of windows."""
    tree, n = CapacityTree(size), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if found := tree.take(length):
            room, at = found
        else:
            room, at = size, n
            n += 1
        window[i], offset[i] = at, size - room
        if room > length:
            tree.add(room - length, at)
    return window, offset, n


class Encoder:
    """Ids as by tokenizers; texts of plain code points without an added token go through the same vocabulary as ranks, which is faster."""

    def __init__(self, json_path: str, ranks_path: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def _pieces(batches: Iterator[pa.RecordBatch], json_path: str, ranks_path: str | None, size: int, separator: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(json_path, ranks_path)
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    made = 0
    full: list[tuple] = []
    rest: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal made, full, rest
        window, offset, n = best_fit_decreasing(np.array([x[2] for x in rest], np.int64), size)
        rows = full + [(*x, base + made + int(w), int(o)) for x, w, o in zip(rest, window, offset, strict=True)]
        made += n
        full, rest = [], []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    held = 0
    for part, _, _ in blocks(batches):
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            ids = np.array(encoder.ids(text or "") + [separator], "<u4")
            n = len(ids)
            held += 4 * n
            for at in range(0, n - n % size, size):
                full.append((doc_id, at, size, ids[at : at + size].tobytes(), n, base + made, 0))
                made += 1
            if n % size:
                rest.append((doc_id, n - n % size, n % size, ids[n - n % size :].tobytes(), n))
        if len(rest) >= BLOCK_PIECES or held >= 64 << 20:
            held = 0
            yield flush()
    if full or rest:
        yield flush()


def pack(docs: DataFrame, window: int = WINDOW, separator: int = SEPARATOR, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: ids are little-endian unsigned 32-bit, sequence_id is unique over all."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return through_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _pieces(it, json_path, ranks_path, window, separator), SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

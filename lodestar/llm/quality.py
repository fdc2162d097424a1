"""Quality classification by a factorisation machine.

A document's features are its hashed words (log counts, scaled to unit length) and statistics of its structure and
metadata (lengths, shares of character classes, repetition of words and lines), each put into bins of the training
sample. Every feature has a weight and a vector of FACTORS numbers; the score adds all weights and all pairwise dot
products of vectors, the latter in linear time as half of the squared sum less the sum of squares.

The model is fitted with logistic loss on a sample of labelled rows: those are taken by a hash of doc_id at the rate
that SAMPLE_ROWS rows need (all, if there are fewer), in expectation SAMPLE_ROWS rows. Held-out rows, and the columns
labels, lang, source and doc_id, are never features or learned from.

Edge cases: null and empty texts have statistics of zeros and get a score like any; rows without a label, or with labels
that differ, are not learned from; without any row to learn from every score is 0.5; repeated rows each get a row; a
null doc_id is held out; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.decontamination import Words
from lodestar.llm.language_id import held_out
from lodestar.llm.shared import blocks, mixed, read, through_python

SAMPLE_ROWS, BUCKETS, FACTORS, EPOCHS, BATCH, RATE, DECAY, THRESHOLD = 6000, 1 << 14, 8, 15, 64, 0.05, 2e-5, 0.3
#: Where the sample's quantiles bound the bins of a statistic: close to the ends, where unusual documents are.
QUANTILES = (0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.25, 0.5, 0.75, 0.88, 0.93, 0.96, 0.98, 0.99, 0.995)
BINS = len(QUANTILES)
STATISTICS = ("log bytes", "log words", "mean word", "longest word", "distinct words", "commonest word", "digits", "upper case", "punctuation", "other ASCII", "beyond ASCII", "white space", "lines", "mean line", "repeated lines", "bars", "repeated neighbours", "distinct trigrams")
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_CLASS[124] = 7


def features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents in one buffer: document, bucket and value of each hashed word, ordered by document; and the statistics."""
    n = len(off) - 1
    words = Words(off, data)
    size = np.diff(off).astype(float)
    per = np.diff(words.first).astype(float)
    some, words_or_1 = np.maximum(size, 1), np.maximum(per, 1)
    where = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(where * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8) / some[:, None]
    length = (words.end - words.start).astype(float)
    total = np.bincount(words.doc, length, n)
    longest = np.zeros(n)
    np.maximum.at(longest, words.doc, length)

    def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
        return h[at], doc[at], np.diff(np.r_[at, len(h)])

    h, doc, count = counted(words.hash, words.doc)
    most = np.zeros(n)
    np.maximum.at(most, doc, count)
    whole = words.whole(3)
    _, tri, _ = counted(words.grams(3)[whole], words.doc[whole])
    tri_all = np.maximum(np.bincount(words.doc[whole], minlength=n), 1)
    twins = np.bincount(words.doc[1:][(words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n) if len(words.hash) else np.zeros(n)
    lines, repeated = np.zeros(n), np.zeros(n)
    for i in range(n):
        found = data[off[i] : off[i + 1]].tobytes().split(b"\n")
        lines[i], repeated[i] = len(found), len(found) - len(set(found))
    stats = np.stack([np.log1p(size), np.log1p(per), total / words_or_1, longest, np.bincount(doc, minlength=n) / words_or_1, most / words_or_1, kinds[:, 1], kinds[:, 2], kinds[:, 6], kinds[:, 0], kinds[:, 4], kinds[:, 5], np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), repeated / np.maximum(lines, 1), kinds[:, 7], twins / words_or_1, np.bincount(tri, minlength=n) / tri_all], axis=1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    return doc, (mixed(h) & np.uint64(BUCKETS - 1)).astype(np.int64), value / norm[doc], stats


@dataclass
class Machine:
    edges: np.ndarray  # statistic, bin edge
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def rows(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and binned statistics as one list of document, feature and value."""
        n, k = stats.shape
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(k)], axis=1)
        extra = BUCKETS + np.arange(k) * (BINS + 1) + bins
        return np.r_[doc, np.repeat(np.arange(n), k)], np.r_[bucket, extra.ravel()], np.r_[value, np.full(n * k, 0.5)]

    def raw(self, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and each document's sum of vectors."""
        x = self.vector[feature] * value[:, None]
        sums = np.stack([np.bincount(doc, x[:, f], n) for f in range(x.shape[1])], axis=1)
        return self.bias + np.bincount(doc, self.weight[feature] * value, n) + 0.5 * ((sums * sums).sum(1) - np.bincount(doc, (x * x).sum(1), n)), sums


def train(buckets: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray, labels: np.ndarray) -> Machine:
    """Adagrad on mini-batches, in an order fixed by a seed."""
    rng = np.random.default_rng(7)
    size = BUCKETS + stats.shape[1] * (BINS + 1)
    share = labels.mean() if len(labels) else 0.5
    edges = np.quantile(stats, QUANTILES, axis=0).T if len(labels) else np.zeros((stats.shape[1], BINS))
    m = Machine(edges, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not len(labels) or share in (0, 1):
        return Machine(edges, m.bias if len(labels) else 0.0, m.weight, m.vector * 0)
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            doc = np.concatenate([np.full(len(buckets[i]), k) for k, i in enumerate(some)])
            doc, feature, value = m.rows(doc, np.concatenate([buckets[i] for i in some]), np.concatenate([values[i] for i in some]), stats[some])
            z, sums = m.raw(len(some), doc, feature, value)
            error = 1 / (1 + np.exp(-z)) - labels[some]
            slope = error[doc] * value
            used, place = np.unique(feature, return_inverse=True)
            gw = np.bincount(place, slope, len(used)) / BATCH + DECAY * m.weight[used]
            gv = np.stack([np.bincount(place, slope * (sums[doc, f] - m.vector[feature, f] * value), len(used)) for f in range(FACTORS)], axis=1) / BATCH + DECAY * m.vector[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            m.weight[used] -= RATE * gw / np.sqrt(seen_w[used])
            m.vector[used] -= RATE * gv / np.sqrt(seen_v[used])
            m.bias -= RATE * float(error.mean())
    return m


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, off, data in blocks(batches):
        doc, bucket, value, stats = features(off, data)
        cut = np.searchsorted(doc, np.arange(1, part.num_rows))
        yield pa.RecordBatch.from_arrays(
            [part.column("quality"), pa.array([x.astype("<i2").tobytes() for x in np.split(bucket, cut)], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in np.split(value, cut)], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in stats], pa.binary())],
            names=["quality", "buckets", "values", "stats"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """docs: doc_id, text. labels: doc_id, quality (0 or 1)."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").filter(~held_out())
    n = max(1, marks.count())
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1_000_000, -(-1_000_000 * sample_rows // n))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = docs.select("doc_id", "text").join(marks, "doc_id").select("text", "quality")
    got = through_python(rows, _sampled, "quality int, buckets binary, values binary, stats binary").toLocalIterator()
    y, b, v, s = [], [], [], []
    for r in got:
        y.append(r["quality"])
        b.append(np.frombuffer(r["buckets"], "<i2"))
        v.append(np.frombuffer(r["values"], "<f4"))
        s.append(np.frombuffer(r["stats"], "<f8"))
    order = sorted(range(len(y)), key=lambda i: (s[i].tobytes(), b[i].tobytes(), y[i]))  # as rows come in any order
    stats = np.array([s[i] for i in order]).reshape(len(y), len(STATISTICS))
    return train([b[i].astype(np.int64) for i in order], [v[i].astype(float) for i in order], stats, np.array([y[i] for i in order], float))


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    machine: Machine = held.value
    for part, off, data in blocks(batches):
        doc, bucket, value, stats = features(off, data)
        z, _ = machine.raw(part.num_rows, *machine.rows(doc, bucket, value, stats))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*part.schema.names, "quality_score"])


def score(docs: DataFrame, machine: Machine, keep: list[str] = ("doc_id", "text")) -> DataFrame:
    """The columns `keep` (text among them) and quality_score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return through_python(docs, lambda it: _score(it, held), f"{fields}, quality_score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

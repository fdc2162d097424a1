"""Removal of long repeated passages, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if it lies in a string of LENGTH bytes that also starts elsewhere. In the same run texts are taken as
sequences of words too (runs without ASCII white space), where strings of PASSAGE words are looked for; those are only
counted, as a passage of that many words may be shorter than LENGTH bytes. The work has two parts for either.

Where to look: of each stretch of neighbouring hashes of GRAM symbols (bytes, or words) the smallest is an anchor, so equal
strings have the same anchor at the same place. An anchor's context is the text of all strings that it stands for. An
anchor hash with one occurrence is settled: nothing there repeats. Equal contexts (by 64 bits of the anchor and 128 of the
context) are one text with a count: if it is two or more, all its strings repeat. What is left are the different contexts
of an anchor, each of them once.

What repeats there: those contexts are laid out by anchor in blocks of about BLOCK bytes. For a block the suffixes are
sorted to the threshold, and their Burrows-Wheeler transform is searched breadth first: intervals of suffixes with a common
prefix are extended backward by one symbol at a time, which derives the common prefixes of neighbouring suffixes in
increasing order; the search stops at the threshold, and the neighbours without a value are those that share as many
symbols or more. A word is two bytes of a hash there, so two different strings of PASSAGE words pass for one with a
chance of 65,025 ** -PASSAGE, or the like in texts of one word repeated.

A block has whole groups, as strings of different groups never meet. An anchor with more than GROUP different contexts is
first cut by range, aligned at the anchor, into cells of CELLS neighbouring starts: strings of a cell have its core in
common, so contexts with different cores are different groups, equal cells are again one text with a count, and groups that
are still over GROUP are cut into smaller cells, down to single strings, where a group is one text. Every row of an anchor
takes part.

Edge cases: null and empty texts have no bytes; a string that overlaps its repetition counts; rows that share a doc_id
are different places (they are numbered apart); a null doc_id is treated like any; nothing is removed from texts under
LENGTH bytes; a cut may leave bytes that are no valid UTF-8, so the rest is returned as binary; an empty table gives no
rows; other columns are ignored. A text is held whole by one task, at some 50 times its bytes while its hashes are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import Rolling, blocks, read, stage_table, through_python, utf8

LENGTH, GRAM, BLOCK, GROUP = 400, 128, 1 << 19, 256
PASSAGE, PASSAGE_GRAM = 51, 12
CELLS = (64, 16, 4, 1)
_ROLL = Rolling()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(off: np.ndarray, sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the strings of a buffer: document, first and one past last start, anchor and its hash, for each run with one anchor."""
    size = len(sums) - 1
    n = size - length + 1
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n <= 0:
        return none
    at = np.arange(size - gram + 1)
    h = _ROLL.ranges(sums, at, at + gram)
    chosen = (_sliding_min((h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = doc[:n] == doc[length - 1 :]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (doc[1:n] != doc[: n - 1]) | ~inside[:-1]] & inside
    start = np.flatnonzero(new)
    if not len(start):
        return none
    stop = np.r_[start[1:], n]
    last = np.flatnonzero(inside)
    stop = last[np.searchsorted(last, stop, "left") - 1] + 1
    return doc[start], start, stop, chosen[start], h[chosen[start]]


def word_ends(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a buffer: offsets of documents in words, first and one past last byte of each word."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    new = np.r_[True, ~solid[:-1]] if len(data) else np.zeros(0, bool)
    cut = off[:-1][np.diff(off) > 0]  # words end with their document
    new[cut] = True
    last = np.r_[~solid[1:], True] if len(data) else np.zeros(0, bool)
    last[cut[1:] - 1] = True
    start, end = np.flatnonzero(new & solid), np.flatnonzero(last & solid) + 1
    return np.searchsorted(start, off), start, end


def word_codes(hashes: np.ndarray) -> np.ndarray:
    """Two bytes under 255 for each word."""
    code = (hashes >> np.uint64(20)) % np.uint64(255 * 255)
    return np.stack([code // np.uint64(255), code % np.uint64(255)], axis=1).astype(np.uint8).ravel()


def _symbols(off: np.ndarray, data: np.ndarray, words: bool, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Offsets of documents in symbols, their bytes (two for a word), and the words' hashes."""
    if not words:
        return off, data, None
    at, start, end = word_ends(off, data)
    h = _ROLL.ranges(_ROLL.prefix(data) if sums is None else sums, start, end)
    return at, word_codes(h), h


def _anchor_rows(batches: Iterator[pa.RecordBatch], sizes: dict[bool, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A row for each different context of a document, with all its places: periodic texts repeat theirs all over."""
    for part, off, data in blocks(batches):
        sums = _ROLL.prefix(data)
        for words, (length, gram) in sizes.items():
            at, body, h = _symbols(off, data, words, sums)
            yield _contexts(part, at, body, sums if h is None else _ROLL.sums(h), words, length, gram)


def _contexts(part: pa.RecordBatch, off: np.ndarray, body: np.ndarray, sums: np.ndarray, words: bool, length: int, gram: int) -> pa.RecordBatch:
    doc, start, stop, chosen, h = anchors(off, sums, length, gram)
    view, u = memoryview(body.tobytes()), 1 + words
    digests = b"".join(xxhash.xxh3_128_digest(view[a * u : (b + length - 1) * u]) for a, b in zip(start.tolist(), stop.tolist(), strict=True))
    c1, c2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    order = np.lexsort((c2, c1, h, doc))
    doc, start, stop, chosen, h, c1, c2 = (x[order] for x in (doc, start, stop, chosen, h, c1, c2))
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])
    first = np.flatnonzero(np.r_[True, ~same]) if len(doc) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array((start - off[doc]).astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), words)), pa.array(h[first].view(np.int64)), pa.array(c1[first]), pa.array(c2[first]), part.column("row").take(pa.array(doc[first])), places, pa.array((stop - start)[first].astype(np.int32)), pa.array((chosen - start)[first].astype(np.int32))],
        names=["words", "anchor", "c1", "c2", "row", "places", "n", "lead"],
    )


def bounded_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes' starts, sorted by their first `depth` symbols at least (the text is taken as a circle)."""
    n = len(text)
    rank, have = text.astype(np.int64), 1
    while have < 8 and rank.max() < 1 << 31:  # join symbols before the first sort
        top = int(rank.max()) + 1
        if top.bit_length() * 2 > 62:
            break
        rank, have = rank * top + np.roll(rank, -have), have * 2
    while True:
        order = np.argsort(rank)  # ties share a rank, in any order
        ordered = rank[order]
        new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if have >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        rank, have = rank * n + np.roll(rank, -have), have * 2


def shares_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it and the one before share `length` symbols without the separator 0 inside.

    Interval expansion in order of common prefix lengths 0, 1, ..., length - 1; what then has no value shares more.
    """
    n = len(text)
    bwt = text[order - 1].astype(np.uint8)
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)  # where the suffix one symbol longer stands
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    first = np.searchsorted(text[order], np.arange(257))
    low, high = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0]
    fresh = ~known[high]
    known[high] = True
    # an interval is extended if its end was new; so is the last one, as n is known from the start
    low, high = low[fresh | (high == n)], high[fresh | (high == n)]
    for _ in range(length - 1):
        if not len(low):
            break
        size = high - low
        rows = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        of = np.repeat(np.arange(len(low)), size)
        symbol = bwt[rows]
        use = symbol != 0
        both = np.sort((of[use] * 256 + symbol[use]) * n + back[rows[use]])
        if not len(both):
            break
        key, to = np.divmod(both, n)  # within a key `to` runs without gaps
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = to[cut], to[np.r_[cut[1:] - 1, len(to) - 1]] + 1
        fresh = ~known[high]
        known[high] = True
        keep = fresh | (high == n)
        low, high = low[keep], high[keep]
    return ~known[:n]


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the starts of its strings of `length` bytes that start elsewhere in the contexts too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.r_[0, np.cumsum(sizes + 1)]
    used = np.unique(np.frombuffer(b"".join(contexts), np.uint8))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)  # UTF-8 never uses all 256 values, so these stay below 256
    text = np.zeros(begin[-1], np.int64)
    for c, a in zip(contexts, begin[:-1].tolist(), strict=True):
        text[a : a + len(c)] = code[np.frombuffer(c, np.uint8)]
    order = bounded_suffix_order(text, length)
    share = shares_prefix(text, order, length)
    twin = share | np.r_[share[1:], False]
    hit = np.zeros(len(text), bool)
    hit[order[twin]] = True
    out = []
    for a, n in zip(begin[:-1].tolist(), sizes.tolist(), strict=True):
        out.append(np.flatnonzero(hit[a : a + max(0, n - length + 1)]))
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and one past last of each gapless run."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + 1).tolist(), strict=True))


_SPANS = pa.schema([("words", pa.bool_()), ("row", pa.int64()), ("at", pa.int64()), ("end", pa.int64())])
_UNIT = pa.schema([("words", pa.bool_()), ("row", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()), ("single", pa.bool_()), ("body", pa.binary())])
_UNIT_SQL = "words boolean, row long, at int, n int, lead int, single boolean, body binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _cut_contexts(batches: Iterator[pa.RecordBatch], lengths: dict[bool, int]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for, from whole texts."""
    schema = pa.schema([("anchor", pa.int64()), ("many", pa.bool_()), *_UNIT])
    for part, off, data in blocks(batches):
        wants, rows = part.column("wants").to_pylist(), []
        for words in {w["words"] for ws in wants for w in ws}:
            at, body, _ = _symbols(off, data, words)
            u, more = 1 + words, lengths[words] - 1
            for i, ws in enumerate(wants):
                row = part.column("row")[i].as_py()
                for w in ws:
                    if w["words"] == words:
                        a = int(at[i]) + w["at"]
                        rows.append((w["anchor"], w["many"], words, row, w["at"], w["n"], w["lead"], w["single"], body[a * u : (a + w["n"] + more) * u].tobytes()))
        yield _batch(rows, schema)


def _expand(batches: Iterator[pa.RecordBatch], key: str, lengths: dict[bool, int], block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by words and key; takes whole groups of a key into a block. Returns the repeated spans of single rows."""
    held: list[tuple] = []
    size, last = 0, None

    def search() -> pa.RecordBatch:
        words = held[0][0]
        u, length = 1 + words, lengths[words]
        rows = []
        for (_, row, at, _, single), starts in zip(held, repeated_starts([x[3] for x in held], length * u), strict=True):
            if single:
                starts = starts if u == 1 else starts[starts % u == 0] // u
                rows += [(words, row, at + a, at + b + length - 1) for a, b in _runs(starts)]
        return _batch(rows, _SPANS)

    for b in batches:
        for group, words, row, at, single, body in zip(*(b.column(c) for c in (key, "words", "row", "at", "single", "body")), strict=True):
            now = words.as_py(), group.as_py()
            if held and now != last and (size >= block or now[0] != held[0][0]):
                yield search()
                held, size = [], 0
            last = now
            held.append((now[0], row.as_py(), at.as_py(), body.as_py(), single.as_py()))
            size += len(held[-1][3]) + 1
    if held:
        yield search()


def _searched(units: DataFrame, key: str, lengths: dict[bool, int], block: int) -> DataFrame:
    laid = units.repartition("words", key).sortWithinPartitions("words", key)
    return through_python(laid, lambda it: _expand(it, key, lengths, block), "words boolean, row long, at long, end long")


def _cells(batches: Iterator[pa.RecordBatch], lengths: dict[bool, int], w: int) -> Iterator[pa.RecordBatch]:
    """Cuts units of n strings (the anchor `lead` symbols behind the first start) into cells of w starts."""
    schema = pa.schema([("core", pa.binary()), ("full", pa.binary()), *_UNIT])
    for b in batches:
        for i in range(0, b.num_rows, 256):
            rows = []
            for words, row, at, n, lead, single, body in zip(*(b.slice(i, 256).column(c).to_pylist() for c in _UNIT.names), strict=True):
                u, length, first = 1 + words, lengths[words], 0
                while first < n:
                    cell = (first - lead) // w
                    begin = cell * w + lead  # may lie before the unit's first string
                    stop = min(n, begin + w)
                    text = body[first * u : (stop + length - 1) * u]
                    core = hashlib.sha256(b"%d " % cell + body[(begin + w - 1) * u : max(0, begin + length) * u]).digest()
                    full = hashlib.sha256(b"%d %d %d " % (cell, first - begin, stop - first) + text).digest()
                    rows.append((core, full, words, row, at + first, stop - first, lead - first, single, text))
                    first = stop
            yield _batch(rows, schema)


def crowded_spans(units: DataFrame, lengths: dict[bool, int], most: int = GROUP, block: int = BLOCK) -> DataFrame:
    """words, row, at, end of the repeated strings of units whose field single is true; the others are there to be met."""
    out = None
    for w in CELLS:
        cells = stage_table(through_python(units, lambda it, w=w: _cells(it, lengths, w), f"core binary, full binary, {_UNIT_SQL}"), "cells", whole=True)
        kinds = stage_table(cells.groupBy("words", "full").agg(F.min("core").alias("core"), F.count(F.lit(1)).alias("all"), F.min(F.struct("row", "at", "n", "lead", "single", "body")).alias("one")), "cell-kinds", rows=cells.count())
        n_kinds = kinds.count()
        last = F.col("at") + F.col("n") + F.when(F.col("words"), lengths.get(True, 0) - 1).otherwise(lengths.get(False, 0) - 1)
        found = cells.filter("single").join(kinds.filter("all > 1").select("words", "full"), ["words", "full"], "left_semi").select("words", "row", F.col("at").cast("long").alias("at"), last.cast("long").alias("end"))
        cores = stage_table(kinds.groupBy("words", "core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "cell-cores", rows=n_kinds)
        left = kinds.join(cores, ["words", "core"]).select("words", "core", "kinds", "one.row", "one.at", "one.n", "one.lead", (F.col("one.single") & (F.col("all") == 1)).alias("single"), "one.body")
        left = stage_table(left, "cell-groups", rows=n_kinds)
        found = found.unionByName(_searched(left.filter(F.col("kinds") <= most), "core", lengths, block))
        out = found if out is None else out.unionByName(found)
        units = left.filter(F.col("kinds") > most).drop("core", "kinds")
        if units.isEmpty():
            break
    return out


def _merge(spans: list[dict] | None) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, e in sorted((s["at"], s["end"]) for s in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    return merged


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, data = utf8(b.column("text"))
        kept, removed, runs, words = [], [], [], []
        for i, spans in enumerate(b.column("spans").to_pylist()):
            merged = _merge([s for s in spans or () if not s["words"]])
            body, at, rest = data[off[i] : off[i + 1]].tobytes(), 0, []
            for a, e in merged:
                rest.append(body[at:a])
                at = e
            kept.append(b"".join([*rest, body[at:]]))
            removed.append(sum(e - a for a, e in merged))
            runs.append(len(merged))
            words.append(sum(e - a for a, e in _merge([s for s in spans or () if s["words"]])))
        longs = (pa.array(x, pa.int64()) for x in (removed, runs, words))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), *longs, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = GROUP, block: int = BLOCK, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passage_words (words in strings of `passage` words that also start elsewhere) and kept (binary) of every row."""
    sizes = {False: (length, gram), True: (passage, passage_gram)}
    lengths = {False: length, True: passage}
    ids = docs.select("doc_id", "text")
    repeated = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not repeated.isEmpty():  # number the rows apart, once and for all
        ids = stage_table(ids.withColumn("row", F.monotonically_increasing_id()), "numbered-rows", whole=True)
    else:
        ids = ids.withColumn("row", F.col("doc_id").cast("long"))
    found = stage_table(through_python(ids.filter(F.octet_length("text") >= min(length, 2 * passage - 1)).select("row", "text"), lambda it: _anchor_rows(it, sizes), "words boolean, anchor long, c1 long, c2 long, row long, places array<int>, n int, lead int"), "anchors", whole=True)
    n_found = found.count()
    key, context = ["words", "anchor"], ["words", "anchor", "c1", "c2"]
    groups = found.groupBy(*key).agg(F.sum(F.size("places")).alias("all"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("c1", "c2"))).filter("all > 1")
    groups = stage_table(groups.select(*key, ((F.col("min_c1") == F.col("max_c1")) & (F.col("min_c2") == F.col("max_c2"))).alias("same")), "anchor-groups", rows=n_found)
    shared = stage_table(found.join(groups, key), "anchors-shared", rows=n_found)
    # anchors whose contexts differ: one of each context, and how often it is there
    contexts = stage_table(shared.filter("not same").groupBy(*context).agg(F.sum(F.size("places")).alias("all"), F.min(F.struct("row", F.get("places", F.lit(0)).alias("at"), "n", "lead")).alias("one")), "contexts", rows=shared.count())
    crowds = stage_table(contexts.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds")), "context-counts", rows=contexts.count())
    wants = contexts.join(crowds, key).select("one.row", F.struct(*key, "one.at", "one.n", "one.lead", (F.col("kinds") > most).alias("many"), (F.col("all") == 1).alias("single")).alias("want"))
    wants = wants.groupBy("row").agg(F.collect_list("want").alias("wants"))
    bodies = stage_table(through_python(ids.select("row", "text").join(wants, "row"), lambda it: _cut_contexts(it, lengths), f"anchor long, many boolean, {_UNIT_SQL}"), "context-bodies", whole=True)
    # equal contexts repeat whole, whether or not others of their anchor differ
    equal = contexts.filter("all > 1").select(*context)
    whole = shared.filter("same").select("words", "row", "places", "n").unionByName(shared.filter("not same").join(equal, context, "left_semi").select("words", "row", "places", "n"))
    end = F.col("at") + F.col("n") + F.when(F.col("words"), passage - 1).otherwise(length - 1)
    whole = whole.select("words", "row", F.explode("places").alias("at"), "n").select("words", "row", F.col("at").cast("long").alias("at"), end.cast("long").alias("end"))
    spans = whole.unionByName(_searched(bodies.filter("not many"), "anchor", lengths, block))
    crowd = bodies.filter("many").select(*_UNIT.names)
    if not crowd.isEmpty():
        spans = spans.unionByName(crowded_spans(crowd, lengths, most, block))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("words", "at", "end")).alias("spans"))
    return through_python(ids.join(spans, "row", "left").select("doc_id", "text", "spans"), _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")

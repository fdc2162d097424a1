"""Every operator against a plain version, over nulls, empty and long texts, repeats, ties, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import decontamination, language_id, license_scan, line_dedup, multiset_hash, packing, quality, shared, simhash, suffix_dedup, warc
from lodestar.llm.components import components
from lodestar.llm.shared import BitFilter

from .conftest import SCHEMA, prose


# packing


def test_packing(docs, messy, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = packing.pack(docs).collect()
    want = collections.Counter((r[0], zlib.crc32(np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in messy)
    by_doc = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 1024
        by_doc[r.doc_id, r.doc_tokens].append(r)
    whole = collections.Counter()
    for (doc_id, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in pieces)
        assert sum(r.length for r in pieces) == n * copies
        if copies == 1:
            assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
            whole[doc_id, zlib.crc32(b"".join(bytes(r.ids) for r in pieces))] += 1
        else:
            whole[doc_id, zlib.crc32(bytes(pieces[0].ids))] += copies if n <= 1024 else 0
    assert whole == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces[:-1]])) and sum(n for _, n in pieces) <= 1024
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        window, offset, n = packing.best_fit_decreasing(np.array(lengths, np.int64), 50)
        rooms, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = min((r for r in rooms if r >= lengths[i]), default=None)
            rooms.append((fit if fit is not None else 50) - lengths[i])
            if fit is not None:
                rooms.remove(fit)
        used = collections.Counter()
        for w, x in zip(window.tolist(), lengths):
            used[w] += x
        assert sorted(50 - v for v in used.values()) == sorted(rooms) and n == len(rooms) and want == {}


def test_encoders_agree(messy):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    more = ["<|endoftext|> x", "a\u0085b c  \n\n d", "I'm we'LL 12½ “q” – x", "\x1c\x1d é́"]
    for text in [r[1] or "" for r in messy] + more:
        assert e.ids(text) == e.full.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_encoded_as_by_the_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, plain = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(path)
    for text in ["a <|endoftext|> b", "<|endoftext|>", "漢 <|endoftext|>", "<|endoftext |> a"]:
        assert e.ids(text) == plain.encode(text, add_special_tokens=False).ids


# line dedup


def plain_lines(rows):
    first, last = {}, {}
    for doc_id, text in rows:
        for k in line_dedup.keys(text):
            if k is not None and doc_id is not None:
                first[k], last[k] = min(first.get(k, doc_id), doc_id), max(last.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line, k in zip(lines, line_dedup.keys(text)) if k is None or doc_id is None or first[k] == last[k] or first[k] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(docs, messy, empty):
    got = [tuple(r) for r in line_dedup.line_dedup(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == sorted(plain_lines([r[:2] for r in messy]), key=str)
    assert sum(r[3] for r in got) > 8
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_keys():
    assert line_dedup.keys(" \tABCÉ 6789012\x0b\r\nshort") == ["abcÉ 6789012".encode(), None]
    assert line_dedup.keys(None) == [None]


def test_filters_of_a_range():
    rng = np.random.default_rng(7)
    for n in (0, 1, 500, 200_000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        f = line_dedup.twice(np.r_[h, h[: n // 10]])
        assert f.has(h[: n // 10]).all() and f.has(h[n // 10 :]).sum() <= 0.02 * n  # of any size, few single ones are suspected


def test_a_line_that_most_documents_hold(spark):
    rows = [(i, f"the common line\nline number {i % 700} of its own\n{'the common line' if i % 3 else 'shorter'}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in line_dedup.line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got) == sorted(plain_lines(rows))
    kept = line_dedup.suspected(df).count()
    assert kept == sum(len({k for k in line_dedup.keys(t) if k}) for _, t in rows)


def test_bit_filter_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    f = BitFilter.of(h[:2500], 1 << 16)
    assert f.has(h[:2500]).all() and f.has(h[2500:]).mean() < 0.05


# decontamination


def plain_hits(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, of = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    of |= got
        out.append((doc_id, len(w), len(hit), sorted(of)))
    return out


def test_decontamination(spark, docs, clean, empty):
    texts = [r[1] for r in clean if r[1]]
    items = [(1, " ".join(texts[3].split()[:14])), (2, texts[5]), (3, "only three words"), (4, None), (5, ""), (6, "same same same same"), (7, "Changed"), (10, " ".join(texts[3].split()[2:13])), (11, "漢字 🙂")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1)).withColumn("doc_id", F.lit(2))
    only = docs.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(only, bench).collect()]
    assert sorted(got) == sorted(plain_hits([r[:2] for r in clean], items))
    assert sum(g[2] > 0 for g in got) > 5
    rows = [(7, texts[3]), (7, texts[3]), (7, texts[5]), (None, texts[3]), (None, texts[5]), (8, None)]  # ids that are null or repeated: every row by itself
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()]
    assert sorted(got, key=str) == sorted(plain_hits(rows, items), key=str)
    none = decontamination.contamination(docs, bench.limit(0)).collect()
    assert {r.n_hit for r in none} == {0} and any(r.doc_id is None for r in none)
    assert decontamination.contamination(empty, bench).count() == 0


# language


def test_language_id(spark, docs, empty, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(8, 60)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = {r.doc_id: r for r in language_id.identify(train, model).withColumn("held", language_id.held_out()).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held == (i in held) for i in got)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    numerals = spark.createDataFrame([(1, "½ ² Ⅷ ① 12"), (2, "½the² ¾ing"), (3, "Ⅷ\u0301")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(numerals, model).orderBy("doc_id").collect()] == ["und", "en", "und"]
    assert language_id.words("½the² x①Y ab") == ["the", "x", "y", "ab"]
    odd = language_id.identify(docs, model).collect()
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_forward_sums_over_all_segmentations():
    pieces = {language_id.MARK: 1, "a": 2, "b": 3, "ab": 4, language_id.MARK + "a": 5, "ba": 6, "bab": 7}
    prob = np.random.default_rng(1).random((8, 2)) + 0.01
    found = ["ab", "abab", "zb", "bab", "a" * 20]

    def plain(word, lang):
        if not word:
            return 1.0
        return sum(prob[p if (p := pieces.get(word[:k])) is not None else 0, lang] * plain(word[k:], lang) for k in range(1, len(word) + 1) if k == 1 or word[:k] in pieces)

    lattice = language_id.Lattice(found, language_id.prefixes(pieces))
    got = lattice.likelihood(prob)
    for i, w in enumerate(found):
        for lang in (0, 1):
            assert got[i, lang] == pytest.approx(np.log(plain(language_id.MARK + w, lang)))
    use = lattice.expected(prob[:, :1], np.ones(len(found)))
    h = 1e-6  # the expected uses are the slope of the log-likelihood in the log of each probability
    for p in range(8):
        up = prob[:, :1].copy()
        up[p] *= 1 + h
        slope = (lattice.likelihood(up)[:, 0] - lattice.likelihood(prob[:, :1])[:, 0]).sum() / h
        assert use[p] == pytest.approx(slope, abs=1e-3)


# suffix dedup


def plain_repeats(texts, length):
    c = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def plain_passages(texts, n):
    """Words of each text that lie in n words in a row that also start elsewhere."""
    split = [re.findall(rb"[^ \t-\r]+", t) for t in texts]
    c = collections.Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    return [len({i + k for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for k in range(n)}) for w in split]


@pytest.mark.parametrize("most", [1000, 6, 0])
def test_suffix_dedup(spark, docs, messy, empty, most):
    rng = np.random.default_rng(8)
    base = rng.integers(97, 105, 200).astype(np.uint8)
    texts = [r[1] for r in messy]
    for _ in range(40):
        x = base.copy()
        x[rng.integers(0, 200, rng.integers(0, 5))] = 122
        texts.append((rng.integers(97, 105, 30).astype(np.uint8).tobytes() + x[rng.integers(0, 30) :].tobytes()).decode())
    words = prose(random.Random(5), "fr", 60).split()
    for i in range(40):  # passages of words, with blanks of any kind
        w = [*words[i % 7 : 30 + i % 9], *prose(random.Random(i), "de", 9).split(), *words[i % 5 : 20]]
        w[i % len(w)] = "other"
        texts.append((" ", "\t", " \n ")[i % 3].join(w))
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_passage_words) for r in suffix_dedup.remove_repeats(df, 40, 8, most, passage=11, passage_gram=3).collect()]
    bodies = [(t or "").encode() for t in texts]
    want = [(*x, n) for x, n in zip(plain_repeats(bodies, 40), plain_passages(bodies, 11), strict=True)]
    assert sorted(got) == sorted(want) and sum(w[-1] > 0 for w in want) > 40
    if most == 6:
        assert suffix_dedup.remove_repeats(docs).count() == len(messy)
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_little_data_in_many_partitions_makes_few_files(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(97, 105, 200).astype(np.uint8)
    texts = []
    for _ in range(60):
        x = base.copy()
        x[rng.integers(0, 200, 4)] = 122
        texts.append((rng.integers(97, 105, 60).astype(np.uint8).tobytes() + x.tobytes()).decode())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, since = {k: spark.conf.get(k) for k in held}, shared.mark()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 40, 8, 6, passage=11, passage_gram=3).collect()]
        many = shared.stage_table(spark.range(8 * shared.TASK_ROWS, numPartitions=5), "many", rows=8 * shared.TASK_ROWS)
        assert len(many.inputFiles()) == 5  # much data keeps its partitions
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(plain_repeats([t.encode() for t in texts], 40))
    files = {p: spark.read.parquet(p) for p in shared._written[since:]}
    files = {p: len(d.inputFiles()) for p, d in files.items() if re.search(r"/(anchor-groups|anchors-shared|contexts|context-counts|cell-kinds|cell-cores|cell-groups)-", p)}
    assert len(files) >= 7 and max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_words_of_a_buffer():
    texts = [b"", b"one", b" two  three\n", b"\x0b", b"four", b"five six", b""]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, start, end = suffix_dedup.word_ends(off, data)
    assert [[data[a:b].tobytes() for a, b in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)] == [t.split() for t in texts]
    assert [len(x) for x in suffix_dedup.word_ends(np.zeros(2, np.int64), np.zeros(0, np.uint8))] == [2, 0, 0]


def test_interval_expansion():
    rng = random.Random(2)
    for length in (1, 2, 5, 9):
        for _ in range(60):
            contexts = [bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 7))]
            c = collections.Counter(x[i : i + length] for x in contexts for i in range(len(x) - length + 1))
            want = [[i for i in range(len(x) - length + 1) if c[x[i : i + length]] > 1] for x in contexts]
            assert [g.tolist() for g in suffix_dedup.repeated_starts(contexts, length)] == want


# fingerprints


def test_multiset_fingerprints(spark, docs, clean, messy, empty):
    df = spark.createDataFrame([r[:2] for r in clean], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("half", F.lit(2))
    got = {r.doc_id: r for r in multiset_hash.fingerprint_edits(df).collect()}
    rows = sorted(clean)
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        assert got[doc_id].edited == text[: len(text) - half] + after[:half] and got[doc_id].n_chars == len(text)
        assert 0 <= got[doc_id].near_edited <= 1 and 0 <= got[doc_id].near_next <= 1
        if after == text:
            assert got[doc_id].near_next == 1.0
    by_text = collections.defaultdict(set)
    for doc_id, text, *_ in rows:
        by_text[text or ""].add(tuple(got[doc_id].fp))
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1
    assert multiset_hash.fingerprint_edits(docs).count() == len(messy)
    assert multiset_hash.fingerprint_edits(empty).count() == 0


def plain_fingerprint(text):
    """The vector as unpacked components: count, sums, lanes."""
    pieces = [m for part in re.split(r"(?<=\n)|(?<=[.!?] )", text) for m in re.findall(r"((?:[^ ]* ){1,8}|[^ ]+\Z)", part)]
    h = [[xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)) for p in pieces] for k in range(4)]
    sums = [sum(x >> j & 0xFFFFFFFF for x in h[k]) % (1 << 32) for k in (0, 1) for j in (0, 32)]
    lanes = [sum(x >> j + 20 * i & 1 for x in h[k]) % (1 << 20) for k in (2, 3) for j in range(20) for i in range(3)]
    return [len(pieces), *sums, *lanes]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - f[0] for v in f[5:]] for f in (a, b))
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return max(0.0, min(1.0, sum(v * w for v, w in zip(x, y, strict=True)) / norm)) if norm else 0.0


def test_multiset_fingerprints_against_plain_ones(spark, clean):
    rows = sorted((d, t or "") for d, t, *_ in clean)
    unpack = lambda fp: [*fp[:5], *(v >> 20 * i & 0xFFFFF for v in fp[5:] for i in range(3))]
    got = {r.doc_id: r for r in multiset_hash.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        own, edited, following = (plain_fingerprint(t) for t in (text, text[: len(text) - half] + after[:half], after))
        r = got[doc_id]
        assert unpack(r.fp) == own and unpack(r.edited_fp) == edited
        assert r.near_edited == pytest.approx(plain_likeness(own, edited)) and r.near_next == pytest.approx(plain_likeness(own, following))


def test_fingerprints_add_and_subtract_in_any_order(spark):
    parts = ["One two. ", "Three four! ", "five\n", "six seven? "]
    df = spark.createDataFrame([("".join(parts), "".join(reversed(parts)), "".join(parts[:2]), "".join(parts[2:]))], "a string, b string, c string, d string")
    for x in "abcd":
        df = multiset_hash.with_fingerprint(df, x, f"f{x}")
    both = multiset_hash.combine(F.col("fc"), F.col("fd"))
    r = df.select((F.col("fa") == F.col("fb")).alias("order"), (both == F.col("fa")).alias("sum"), (multiset_hash.combine(both, F.col("fd"), -1) == F.col("fc")).alias("less")).first()
    assert r.order and r.sum and r.less


# quality


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    good = [(prose(rng, "en", rng.randint(20, 80)) + ".", 1) for _ in range(150)]
    bad = [(" | ".join(prose(rng, "en", 1) for _ in range(40)), 0) for _ in range(40)] + [((prose(rng, "de", 1) + " ") * 50, 0) for _ in range(40)]
    rows = [(i, t, q) for i, (t, q) in enumerate(good + bad)]
    rng.shuffle(rows)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, 1), (0, 0), (None, 1), (9999, None)], "doc_id long, quality int")
    machine = quality.fit(df, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(df, machine).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= quality.THRESHOLD) == bool(q) for i, _, q in held]) > 0.9
    assert all(0 <= r.quality_score <= 1 for r in quality.score(docs, machine).collect())
    assert quality.score(empty, machine).count() == 0
    blank = quality.fit(df, labels.limit(0))
    assert {r.quality_score for r in quality.score(df, blank).collect()} == {0.5}


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    k = len(quality.STATISTICS)
    m = quality.Machine(np.zeros((k, quality.BINS)), 0.3, rng.normal(size=quality.BUCKETS + k * (quality.BINS + 1)), rng.normal(size=(quality.BUCKETS + k * (quality.BINS + 1), 4)))
    f, x = np.array([1, 5, 9, 12]), np.array([0.5, 1.0, -2.0, 0.25])
    z, _ = m.raw(1, np.zeros(4, int), f, x)
    pairs = sum(m.vector[f[i]] @ m.vector[f[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert z[0] == pytest.approx(0.3 + m.weight[f] @ x + pairs)


# archives


def test_warc(spark, tmp_path, empty):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2 x\n", "<p>é</p>"), (3, None, None), (5, "u", ""), (4, "u", "z" * 50_000), (9, "u", "q"), (9, "u", "q"), (None, "n", "q"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("x")).repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    assert index.count() == len(rows)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(index).collect()}
    d = lambda s: warc.payload_digest(s.encode())
    assert got == {
        (2, "response", None, d("<p>é</p>"), "<p>é</p>".encode()), (1, "revisit", 2, d("<p>é</p>"), None), (5, "response", None, d(""), b""), (3, "revisit", 5, d(""), None),
        (4, "response", None, d("z" * 50_000), b"z" * 50_000), (9, "response", None, d("q"), b"q"), (None, "revisit", 9, d("q"), None), (None, "response", None, d("alone"), b"alone"),
    }
    some = warc.read_archives(index.filter("page_id in (2, 4)"))
    assert sorted(r.page_id for r in some.collect()) == [2, 4]
    large = warc.write_archives(pages.filter("page_id < 5"), str(tmp_path / "m"), min_bytes=100)
    assert {r.record_type for r in large.collect()} == {"response"}
    none = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(none).count() == 0


# near duplicates


def plain_components(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_fingerprint_bits():
    text = "A b  C\td e"
    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d", "c d e")]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("X y") == xxhash.xxh64_intdigest("x y", 42) and simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")


@pytest.mark.parametrize(("distance", "bucket"), [(2, 64), (2, 1), (3, 0), (4, 64)])
def test_deletion_variants(spark, distance, bucket):
    rng = np.random.default_rng(3)
    u = rng.integers(0, 2**64, 60, dtype=np.uint64)
    for k in range(1, 4):
        x = np.repeat(u[:4], 12)
        for _ in range(k):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
        u = np.concatenate([u, x])
    u = np.unique(u)
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if int(u[i] ^ u[j]).bit_count() <= distance}
    place = {int(v): i for i, v in enumerate(u.view(np.int64))}
    df = spark.createDataFrame([(int(v),) for v in u.view(np.int64)], "fp long")
    got = {tuple(sorted((place[r.a], place[r.b]))) for r in simhash.links(df, distance, bucket).collect()}
    assert got <= want and plain_components(len(u), got) == plain_components(len(u), want)
    if bucket == 64:
        assert got == want


def test_simhash(docs, messy, empty):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp) for r in got) == sorted((str(d), simhash.fingerprint(t) - (1 << 64 if simhash.fingerprint(t) >> 63 else 0)) for d, t, *_ in messy)
    rows = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got]
    want = plain_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2])
    ids = collections.defaultdict(list)
    for w, (d, _, _) in zip(want, rows):
        ids[w].append(d)
    for w, (_, _, c) in zip(want, rows):
        assert c == min((d for d in ids[w] if d is not None), default=None)
    assert simhash.near_duplicates(empty).count() == 0


def test_parities():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 300, 5000):
        x, y = (rng.integers(0, 2**64, n + 3, dtype=np.uint64) for _ in range(2))
        y[: n * 9 // 10] = x[: n * 9 // 10]
        odd = [simhash.parities(np.unique(h)).view(np.uint64) for h in (x, y)]
        bits = [np.unpackbits(o.view(np.uint8), bitorder="little") for o in odd]
        for b, h in zip(bits, (x, y), strict=True):
            assert b.tolist() == [sum(1 for v in h if v % simhash.PARITY_BITS == at) % 2 for at in range(simhash.PARITY_BITS)] if n < 300 else b.sum() % 2 == len(h) % 2
        folded = [np.bitwise_xor.reduce(o.reshape(-1, simhash.FOLDED_BITS // 64)) for o in odd]
        only = len(set(x.tolist()) ^ set(y.tolist()))
        assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= np.bitwise_count(odd[0] ^ odd[1]).sum() <= only


def test_similar_documents(docs, messy, empty, spark):
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect() if r.doc_id is not None}
    by_id = {d: t for d, t, *_ in messy if d is not None}
    ids = sorted(by_id)
    words = {d: simhash._words(by_id[d]) for d in ids}
    links = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if simhash.shingle_similarity(words[ids[i]], words[ids[j]]) >= 0.8]
    want = plain_components(len(ids), links)
    want = {d: ids[w] for d, w in zip(ids, want)}
    assert got == want and len(links) > 5
    assert simhash.similar_documents(empty).count() == 0


def test_similar_documents_recall(spark):
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = prose(rng, "en", rng.randint(40, 300)).split()
        rows.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = prose(rng, "en", 1)
            rows.append(" ".join(w))
    words = [r.encode().split() for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, min(len(rows), i + 4)) if simhash.shingle_similarity(words[i], words[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and all(got[a] == got[b] for a, b in pairs)


def similar_components(spark, rows):
    """Components found, and by comparing all pairs; the pairs."""
    words = [r.encode().split() for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if simhash.shingle_similarity(words[i], words[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(rows))], plain_components(len(rows), pairs), pairs


def test_similar_documents_between_strangers_of_a_hot_source(spark):
    rng = random.Random(21)
    fixed = prose(rng, "en", 200).split()
    fresh = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    page = lambda: [x for i, w in enumerate(fixed) for x in ([w, fresh()] if i % 12 == 11 else [w])]
    pages = [page() for _ in range(150)]
    for w in pages[:40]:
        w = list(w)
        w[rng.randrange(len(w))] = fresh()
        pages.append(w)
    # and a large group of which each is like the one before only
    chain = prose(rng, "en", 100).split()
    for _ in range(120):
        chain = chain[8:] + prose(rng, "en", 8).split()
        pages.append(chain)
    rng.shuffle(pages)
    got, want, pairs = similar_components(spark, [" ".join(w) for w in pages])
    assert got == want and len(pairs) >= 150


def test_similar_documents_cut_extended_and_short(spark):
    rng = random.Random(22)
    rows = []
    for _ in range(40):
        w = prose(rng, "en", rng.randint(150, 500)).split()
        n = len(w)
        more = lambda share: prose(rng, "de", int(n * share)).split()
        rows += [w, w[: int(n * 0.82)], w + more(0.2), more(0.1) + w + more(0.1), w[int(n * 0.1) : int(n * 0.95)]]
        short = prose(rng, "fr", rng.randint(14, 50)).split()
        rows += [short, short + prose(rng, "fr", max(1, len(short) // 8)).split(), short[: -max(1, len(short) // 8)]]
    got, want, pairs = similar_components(spark, [" ".join(w) for w in rows])
    assert got == want and len(pairs) > 200


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = plain_components(300, [(a, b) for a, b in links if a != b])
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# licences


def test_license_scan(spark, empty):
    files = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x.c", "/* Licensed under the Apache License, Version 2.0. */\nint main" + " more code" * 30), (3, "r/a/y.c", "int y;"), (4, "r/a/b/z.c", None), (5, "s/q.c", ""),
        (6, "s/t/COPYING", "long preface of many words that say nothing at all about this\nThis work is licensed under the GNU General Public License, version 3.\n" + "more words " * 30), (7, "s/t/u/v.c", "the license of nothing in particular"), (8, None, "Released under the MIT License."), (9, None, "x"), (3, "r/a/y.c", "int y;"),
    ]
    df = spark.createDataFrame(files, "id long, path string, text string").withColumn("row", F.lit(1)).withColumn("own", F.lit(2))
    got = sorted((r.id, r.license, r.origin, r.from_dir) for r in license_scan.scan(df).collect())
    assert got == [(1, "MIT", "own", None), (2, "Apache-2.0", "own", None), (3, "MIT", "inherited", "r"), (3, "MIT", "inherited", "r"), (4, "MIT", "inherited", "r"), (5, None, "none", None), (6, "GPL-3.0", "own", None), (7, "GPL-3.0", "inherited", "s/t"), (8, "MIT", "own", None), (9, None, "none", None)]
    assert license_scan.scan(df.limit(0)).count() == 0
    assert license_scan.scan(license_scan.document_files(empty)).count() == 0


def test_license_scan_of_wrapped_statements(spark):
    import textwrap

    files = [(i, f"w/{i}/x.c", textwrap.fill(text, 24)) for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r.id: (r.license, r.origin) for r in license_scan.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {i: (name, "own") for i, (name, _) in enumerate(license_scan.TEMPLATES)}


def test_license_scan_of_texts_and_headers(spark):
    texts = {
        "MIT": "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
        "BSD-2-Clause": "Copyright (c) 2001, A. Person\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
        "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os\n" + "value = other_value + 1\n" * 40,
        "Apache-2.0": "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n */\n" + "call(some, arguments);\n" * 30,
    }
    files = [(i, f"d{i}/x", t) for i, t in enumerate(texts.values())]
    files += [(9, "d9/x", "software may be used by any person for a purpose, and copies of the notice are free\n" * 3)]
    got = {r.id: r.license for r in license_scan.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {**dict(enumerate(texts)), 9: None}


def test_cue_pattern():
    words = ["a", "ab", "abc", "b.1", "bc", "license", "licensed", "c+"]
    pattern = re.compile(license_scan._any_of(words))
    assert all(pattern.fullmatch(w) for w in words) and not any(pattern.fullmatch(w) for w in ["", "abcd", "bx1", "b", "licens", "licensee"])


def test_no_python_in_native_plans(docs):
    for df in (multiset_hash.fingerprint_edits(docs), license_scan.scan(license_scan.document_files(docs.drop("id", "path")))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)

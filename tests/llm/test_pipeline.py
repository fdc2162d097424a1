"""The pipeline's stages on their own inputs, and the registered queries on the smallest tables."""

import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import catalogue, decontamination, language_id, simhash

from .conftest import SCHEMA
from .test_operators import plain_components, plain_fingerprint, plain_hits, plain_likeness, plain_lines, plain_passages, plain_repeats

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def sf(spark, clean, tmp_path):
    texts = [r[1] for r in clean if r[1]]
    spark.createDataFrame([(1, " ".join(texts[4].split()[2:14])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(clean, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id: r for r in corpus_pipeline.identify(spark, docs, sf).collect()}
    assert all(any(c.isalpha() for c in rows[d].text) for d in kept)
    gone = [r for d, r in rows.items() if d not in kept]
    assert all(not any(c.isalpha() for c in r.text or "") for r in gone) and gone
    docs = spark.createDataFrame(list(kept.values()), docs.schema)

    lines = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert lines.columns == corpus_pipeline.COLUMNS
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {d: (t, len(t)) for d, t, _, _ in plain_lines([(r.doc_id, r.text) for r in kept.values()])}
    docs = spark.createDataFrame([(d, t, kept[d].lang, kept[d].source, n) for d, (t, n) in got.items()], SCHEMA)

    ids = sorted(got)
    words = [simhash._words(got[d][0]) for d in ids]
    want = plain_components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if simhash.shingle_similarity(words[i], words[j]) >= 0.8])
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert {d for d, w in zip(ids, want) if ids[w] == d} <= left and len(left) < len(ids)

    docs = docs.filter(F.col("doc_id").isin(list(left)))
    texts = [(d, got[d][0]) for d in left]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean_ids = {d for d, _, n, _ in plain_hits(texts, items) if not n}
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()} == clean_ids and len(clean_ids) < len(left)

    pieces = corpus_pipeline.pack(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == len(left)


def test_stages_with_null_and_repeated_ids(spark, sf, clean):
    texts = [r[1] for r in clean if r[1]]
    passage = " ".join(texts[4].split()[2:14])
    copy, other, third = "one text that several rows of the table hold in full", "a second text that shares its number with another row", "a third text which only a row without a number has"
    rows = [(7, copy), (None, copy), (7, copy), (None, third), (None, third), (8, other), (8, third + " and more words than that one has"), (None, passage), (9, passage), (9, other + " but no passage")]
    docs = spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in rows], SCHEMA)
    key = lambda r: (str(r[0]), r[1])
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()), key=key)
    assert left == sorted([(7, copy), (None, third), *rows[5:7], (9, passage), rows[9]], key=key)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()), key=key)
    assert left == sorted([r for r in rows if r[1] != passage], key=key)


def test_run_and_stage_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = catalogue.QUERIES[name](spark, DATA)
    result = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(result.fetchall(), key=key)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def check_packing(order, texts, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0] for d in order}
    windows, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for parts, size in [(sorted(p), None) for p in windows.values()] + [(sorted(p), len(ids[d])) for d, p in pieces.items()]:
        ends = [0, *(a + n for a, n in parts)]
        assert [a for a, _ in parts] == ends[:-1] and (ends[-1] <= 1024 if size is None else ends[-1] == size)
    assert sum(map(len, ids.values())) > 0.9 * 1024 * len(windows)


def check_repeats(order, texts, rows):
    bodies = [texts[d].encode() for d in order]
    want = {d: (n, gone, runs, sha(kept), words) for d, (n, gone, runs, kept), words in zip(order, plain_repeats(bodies, 400), plain_passages(bodies, 51), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in rows} == want


def check_edits(order, texts, rows):
    got = {r.doc_id: r for r in rows}
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        text, half = texts[d], len(texts[d]) // 2
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == sha(text[: len(text) - half] + texts[after][:half])
        own, edited, following = (plain_fingerprint(t) for t in (text, text[: len(text) - half] + texts[after][:half], texts[after]))
        assert got[d].near_edited == pytest.approx(plain_likeness(own, edited)) and got[d].near_next == pytest.approx(plain_likeness(own, following))


def check_fingerprints(order, texts, rows):
    bits = [simhash.fingerprint(texts[d]) for d in order]
    roots = plain_components(len(order), [(i, j) for i in range(len(order)) for j in range(i + 1, len(order)) if (bits[i] ^ bits[j]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{b:016x}", order[root]) for d, b, root in zip(order, bits, roots, strict=True)}


PLAIN = {"op1_packing": check_packing, "op5_suffix_dedup": check_repeats, "op7_document_fingerprint": check_edits, "op10_simhash": check_fingerprints}


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_queries_run_over_whole_tables(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    order = sorted(texts)
    if check := PLAIN.get(name):
        check(order, texts, rows)
    if name == "op4_language_id":
        langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
        assert sum(langs[r.doc_id] == r.lang_pred for r in rows if r.held_out) / max(1, sum(r.held_out for r in rows)) > 0.95

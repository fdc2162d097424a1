"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all its
segmentations into pieces of the product of their probabilities, found by the forward algorithm; a text's is the product
over its words. Probabilities come from expectation maximisation over the same segmentations (forward and backward).

Words are runs of letters (as Unicode has them: no digits or other numerals), lower-cased, with the vocabulary's word mark in front; runs over MAX_WORD letters are scored in
stretches of MAX_WORD. A letter that is no piece counts as the unknown piece. All words of a text are scored; likelihoods
of words are kept from document to document up to MEMORY words, which changes speed only.

The model is fitted on a sample of whole documents: each language's documents are taken by a hash of doc_id at the rate
that SAMPLE_DOCS documents need (all, if there are fewer), in expectation SAMPLE_DOCS for each language.

Edge cases: null texts and texts without a letter are `und` with score 0, and so is everything if no row can be learned
from; empty tables give no rows; repeated rows each get a row; ties go to the language first in code-point order; a null
doc_id is never learned from and is held out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import blocks, read, through_python

FOLDS, SAMPLE_DOCS, ROUNDS, SMOOTHING, MAX_WORD, MAX_PIECE, MEMORY = 5, 300, 5, 0.05, 32, 16, 400_000
MARK, UNKNOWN, UND = "▁", 0, "und"
_RUN = re.compile(r"[^\W\d_]+")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(True))


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of letters (with or without the word mark) and their numbers from 1; 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = dict.fromkeys(p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and len(p := model.id_to_piece(i).lower()) <= MAX_PIECE)
    return {p: i for i, p in enumerate((p for p in pieces if p == MARK or _RUN.fullmatch(p.removeprefix(MARK) or "")), 1)}


def words(text: str | None) -> list[str]:
    runs = _RUN.findall((text or "").lower())
    if not all(map(str.isalpha, runs)):  # the pattern takes numerals such as fractions for letters
        runs = [x for run in runs for x in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split(" ")) if x]
    if max(map(len, runs), default=0) <= MAX_WORD:
        return runs
    return [run[i : i + MAX_WORD] for run in runs for i in range(0, len(run), MAX_WORD)]


def prefixes(pieces: dict[str, int]) -> dict[str, int]:
    """Every beginning of a piece: the piece's number, or -1 if it is none itself."""
    out = {p[:i]: -1 for p in pieces for i in range(1, len(p))}
    return {**out, **pieces}


class Lattice:
    """All pieces that occur in a list of words (65,536 at most): word, start, end and piece number, ordered by end.

    `known` has the pieces' beginnings, so that a search ends where no piece goes on.
    """

    def __init__(self, found: list[str], known: dict[str, int]) -> None:
        rows: list[int] = []
        add, get, longest = rows.append, known.get, 0
        for w, word in enumerate(found):
            word = MARK + word
            n = len(word)
            longest = max(longest, n)
            w <<= 16
            for a in range(n):
                here = w | a << 32
                p = get(word[a])
                if p is None or p < 0:
                    add(here | a + 1 << 40 | UNKNOWN)
                    if p is None:
                        continue
                else:
                    add(here | a + 1 << 40 | p)
                for b in range(a + 2, n + 1):
                    p = get(word[a:b])
                    if p is None:
                        break
                    if p >= 0:
                        add(here | b << 40 | p)
        table = np.sort(np.array(rows, np.int64))
        self.piece, self.word, self.start, self.end = table & 0xFFFF, table >> 16 & 0xFFFF, table >> 32 & 0xFF, table >> 40
        self.width, self.n = longest + 1, len(found)
        self.length = np.array([len(w) + 1 for w in found], np.int64)
        self.cuts = np.searchsorted(self.end, np.arange(1, longest + 2))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sums over segmentations up to each place: (word, place, language)."""
        alpha = np.zeros((self.n, self.width, prob.shape[1]))
        alpha[:, 0] = 1
        for at in range(len(self.cuts) - 1):
            m = slice(self.cuts[at], self.cuts[at + 1])
            np.add.at(alpha, (self.word[m], at + 1), alpha[self.word[m], self.start[m]] * prob[self.piece[m]])
        return alpha

    def likelihood(self, prob: np.ndarray) -> np.ndarray:
        alpha = self.forward(prob)
        return np.log(np.maximum(alpha[np.arange(self.n), self.length], 1e-300))

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece for one language, given each word's count."""
        alpha = self.forward(prob)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.length] = 1
        order = np.argsort(-self.start, kind="stable")
        starts = self.start[order]
        for at in range(self.width - 2, -1, -1):
            m = order[np.searchsorted(-starts, -at, "left") : np.searchsorted(-starts, -at, "right")]
            np.add.at(beta, (self.word[m], at), prob[self.piece[m], 0] * beta[self.word[m], self.end[m]])
        share = alpha[self.word, self.start] * prob[self.piece, 0] * beta[self.word, self.end] * (counts / np.maximum(beta[:, 0], 1e-300))[self.word]
        return np.bincount(self.piece, share, len(prob))


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray  # piece, language
    prior: np.ndarray  # log, by language
    key: str = ""  # tells fits apart


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            found.update((lang, w) for w in words(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, path: str | None = None) -> Model:
    """docs: doc_id, text, lang. Held-out rows and rows without lang are left out here."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, pieces = sorted(sizes), vocabulary(path)
    known = prefixes(pieces)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rates = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1_000_000, -(-1_000_000 * sample_docs // sizes[k]))))) if languages else None
    counts: dict[str, dict[str, int]] = {k: {} for k in languages}
    if languages:
        for r in through_python(rows.filter(place < F.element_at(rates, F.col("lang"))).select("lang", "text"), _word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["lang"]][r["word"]] = r["n"]
    prob = np.zeros((len(pieces) + 1, len(languages)))
    for i, lang in enumerate(languages):
        p = np.full((len(prob), 1), 1 / len(prob))
        if counts[lang]:
            found = sorted(counts[lang])
            parts = [found[i : i + (1 << 14)] for i in range(0, len(found), 1 << 14)]
            lattices = [(Lattice(x, known), np.array([counts[lang][w] for w in x], float)) for x in parts]
            for _ in range(ROUNDS):
                use = sum(lattice.expected(p, n) for lattice, n in lattices) + SMOOTHING
                p = (use / use.sum())[:, None]
        prob[:, i] = p[:, 0]
    total = sum(sizes.values())
    return Model(languages, pieces, prob, np.log(np.array([sizes[k] / total for k in languages])), uuid.uuid4().hex)


class _Memory:
    """Words' likelihoods under one model; a worker keeps the last model's for its next tasks."""

    last: _Memory | None = None

    def __init__(self, model: Model) -> None:
        self.key, self.starts = model.key, prefixes(model.pieces)
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    @classmethod
    def of(cls, model: Model) -> _Memory:
        if cls.last is None or cls.last.key != model.key:
            cls.last = cls(model)
        return cls.last


def _scores(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model: Model = held.value
    memory = _Memory.of(model)
    for part, _, _ in blocks(batches):
        found = [Counter(words(t.as_py())) for t in part.column("text")]
        if len(memory.place) > MEMORY:
            memory.place, memory.table = {}, memory.table[:0]
        known = memory.place
        fresh = list({w for c in found for w in c if w not in known}) if model.languages else []
        rows = [memory.table]
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            rows.append(Lattice(some, memory.starts).likelihood(model.prob))
            known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
        memory.table = table = np.concatenate(rows)
        best, score = [], []
        for c in found:
            if not c or not model.languages:
                best.append(UND)
                score.append(0.0)
                continue
            logs = np.fromiter(c.values(), float, len(c)) @ table[np.fromiter(map(known.__getitem__, c), np.int64, len(c))] + model.prior
            p = np.exp(logs - logs.max())
            best.append(model.languages[int(p.argmax())])
            score.append(float(p.max() / p.sum()))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "__text"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "lang_score"])


def identify(docs: DataFrame, model: Model, keep: list[str] = ("doc_id", "text")) -> DataFrame:
    """The columns `keep` (text among them), lang_pred and lang_score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return through_python(docs, lambda it: _scores(it, held), f"{fields}, lang_pred string, lang_score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

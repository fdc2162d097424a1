"""Order-independent document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraphs (cut after each line end and sentence end, and after every eighth word of longer ones,
so that a text of few paragraphs has a likeness too). Each paragraph is hashed to a wide vector; a fingerprint is the sum of those vectors, each component modulo a power of two. Sums make it independent of
order, and let a paragraph be added or taken away by adding or subtracting its own fingerprint (`combine`).

Three kinds of components: the number of paragraphs (modulo 2**40); SUMS uniform ones (modulo 2**32, two of each of SUMS / 2
hashes), for equality; and LANES counts of one hash bit each (modulo 2**20, three to a long), whose centred values are a
random projection of the multiset, so that the cosine of two texts' lanes estimates the cosine of the multisets (standard
error about 0.09). Every hash reads the paragraph itself with a seed of its own, so paragraphs that agree in one differ in
the others: the vector is 256 bits of hash wide.

Edge cases: null and empty texts have no paragraph, and a likeness of 1 to each other and 0 to others; equal texts have equal fingerprints; rows that share a
doc_id each get a row, and stand as the next document by their smallest text; a null doc_id sorts before all others.
Other columns are ignored; an empty table gives no rows.
A text is hashed twice, for itself and as the next one: keeping fingerprints to join them moves more than that saves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import as_text, read, stage_table

#: A paragraph ends after a line end or after a full stop, question or exclamation mark and a blank.
CUT = r"(?<=\n)|(?<=[.!?] )"
#: What a paragraph is cut into: eight words at most, each with the blank behind it.
PIECE = r"((?:[^ ]* ){1,8}|[^ ]+\z)"
PER_LONG, LANE_BITS, STEPS, HASHES, SUMS = 3, 20, 20, 2, 4
LANES = PER_LONG * STEPS * HASHES
_LANE = (1 << LANE_BITS) - 1
_ALL = (1 << PER_LONG * LANE_BITS) - 1
_ONE = sum(1 << LANE_BITS * i for i in range(PER_LONG))
#: Ids for each range that the search for the next document takes as one group.
RANGE_IDS = 1_000_000


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _sum(hashes: Column, part, modulus: int) -> Column:
    return F.aggregate(hashes, _long(0), lambda acc, h: (acc + part(h)).bitwiseAND(_long(modulus - 1)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: array<long> of the count, SUMS uniform sums, then packed lanes."""
    pieces = F.flatten(F.transform(F.split(F.col(text), CUT), lambda p: F.regexp_extract_all(p, F.lit(PIECE), 1)))
    df = df.withColumn("__pieces", pieces)
    out = [F.size("__pieces").cast("long")]
    sums, lanes = [], []
    for k in range(SUMS // 2 + HASHES):
        seed = F.lit(k)  # hashed first, so that the paragraph is hashed anew under each seed
        df = df.withColumn(f"__h{k}", F.transform("__pieces", lambda p: F.xxhash64(seed, p)))  # noqa: B023
        if k < SUMS // 2:
            sums += [_sum(F.col(f"__h{k}"), lambda x, j=j: F.shiftrightunsigned(x, j).bitwiseAND(_long((1 << 32) - 1)), 1 << 32) for j in (0, 32)]
        else:
            lanes += [_sum(F.col(f"__h{k}"), lambda x, j=j: F.shiftrightunsigned(x, j).bitwiseAND(_long(_ONE)), _ALL + 1) for j in range(STEPS)]
    return df.withColumn(name, F.array(*out, *sums, *lanes)).drop("__pieces", *(f"__h{k}" for k in range(SUMS // 2 + HASHES)))


def _components(fp: Column) -> list[tuple[Column, int]]:
    """Every component and its modulus, as unpacked."""
    out = [(F.get(fp, F.lit(0)), 1 << 40)] + [(F.get(fp, F.lit(1 + k)), 1 << 32) for k in range(SUMS)]
    for i in range(STEPS * HASHES):
        out += [(F.shiftright(F.get(fp, F.lit(1 + SUMS + i)), LANE_BITS * j).bitwiseAND(_long(_LANE)), 1 << LANE_BITS) for j in range(PER_LONG)]
    return out


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the multisets put together (sign 1), or of a without b's paragraphs (sign -1)."""
    parts = [F.pmod(x + sign * y, _long(m)) for (x, m), (y, _) in zip(_components(a), _components(b), strict=True)]
    packed = parts[: 1 + SUMS]
    for i in range(1 + SUMS, len(parts), PER_LONG):
        packed.append(sum((F.shiftleft(p, LANE_BITS * j) for j, p in enumerate(parts[i + 1 : i + PER_LONG], 1)), parts[i]))
    return F.array(*packed)


def _centred(fp: Column) -> Column:
    n = F.get(fp, F.lit(0))
    lanes = F.slice(fp, 2 + SUMS, STEPS * HASHES)
    return F.flatten(F.transform(lanes, lambda x: F.array(*(F.shiftright(x, LANE_BITS * j).bitwiseAND(_long(_LANE)) * 2 - n for j in range(PER_LONG)))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the cosine of two fingerprints, 0 at least; exactly 1 for equal ones."""
    df = df.withColumn("__a", _centred(F.col(a))).withColumn("__b", _centred(F.col(b)))
    norm = F.sqrt(_dot(F.col("__a"), F.col("__a")) * _dot(F.col("__b"), F.col("__b")))
    df = df.withColumn("__n", norm).withColumn("__d", _dot(F.col("__a"), F.col("__b")))
    like = F.when(F.col(a) == F.col(b), 1.0).when(F.col("__n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__d") / F.col("__n"))))
    return df.withColumn(name, like).drop("__a", "__b", "__n", "__d")


def as_hex(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def next_ids(keys: DataFrame) -> DataFrame:
    """key (long, not null, may repeat) to key, next: the next larger key, after the largest the smallest."""
    keys = keys.select("key").distinct()
    n = max(1, -(-keys.count() // RANGE_IDS))
    placed = stage_table(keys.repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("part")), "id-ranges")
    firsts = placed.groupBy("part").agg(F.min("key").alias("first"))
    every = Window.orderBy("part")  # over one row for each RANGE_IDS ids, not over the ids
    after = firsts.select("part", F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    step = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return placed.withColumn("next", step).join(after, "part").select("key", F.coalesce("next", "after").alias("next"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced from the next document, and likenesses."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), _long(-(1 << 63))).alias("key"), as_text().alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    steps = next_ids(docs.select("key"))
    need = docs.select("key", half.alias("half")).groupBy("key").agg(F.max("half").alias("half")).join(steps, "key").select(F.col("next").alias("key"), F.col("key").alias("of"), "half")
    lent = with_fingerprint(docs.join(need, "key"), "text", "fp").select(F.col("of").alias("key"), F.expr("substring(text, 1, half)").alias("lent"), F.col("fp").alias("next_fp"))
    lent = lent.groupBy("key").agg(F.min(F.struct("lent", "next_fp")).alias("x"))
    both = docs.join(lent, "key").select("key", "text", "x.lent", "x.next_fp").withColumn("n_chars", F.length("text").cast("long")).withColumn("half", half)
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - half), substring(lent, 1, half))"))
    both = with_fingerprint(with_fingerprint(both, "text", "fp"), "edited", "edited_fp")
    both = with_likeness(with_likeness(both, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return both.select(F.when(F.col("key") != _long(-(1 << 63)), F.col("key")).alias("doc_id"), "n_chars", "edited", "fp", "edited_fp", "near_edited", "near_next")


def op7_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")

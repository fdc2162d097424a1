"""SimHash near-duplicates by deletion variants.

A 64-bit fingerprint is cut into DISTANCE // 2 + 1 segments, so that of two fingerprints within DISTANCE bits one
segment differs by one bit at most. Each segment is indexed once for each of its bits taken as a wildcard; equal
variants join and the pair is verified by the count of differing bits. In a variant those with its wildcard bit set meet
those without; pairs that agree there meet once, in the segment as a whole. Equal fingerprints are one node throughout.

Variants in which a fingerprint would meet more than BUCKET others on average are not paired: their members are indexed
whole, with every set of DISTANCE bits as wildcards. Fingerprints with such a key in common are within DISTANCE by construction (at most
2 ** DISTANCE of them share one), so this exact way grows in proportion to the members, not with their square.

A shingle is SHINGLE words in a row (all words of a shorter text); words are split at ASCII white space, A-Z lower-cased.

`similar_documents` finds all documents whose five-word shingles agree to SIMILARITY or more. Deletion variants of a
fingerprint of those shingles propose the first pairs. What they don't reach is found by an exact prefix join: of two
such texts with their shingles in one order, rarest first, the first n - ceil(SIMILARITY * n) + 1 have one in common.
The members of a shingle that many share are first dealt into small groups and compared with the group's smallest one,
so that a large group of near copies hangs together early; then all pairs that share a shingle and are in different
components are compared, wherever sizes, places and parities allow the similarity. Whole texts decide on every pair.

The parities of a text are PARITY_BITS bits, each flipped by every shingle that falls on it. A shingle that only one of
two texts has flips one bit, one that both have flips the same bit in both, so texts differ by at least as many shingles
as their parities differ by bits. That bound is exact, whatever the size; beyond PARITY_BITS shingles it rules out less.
Folding them, by exclusive or of their parts, gives the parities of fewer bits.

Edge cases: null and empty texts have the fingerprint zero, linked like any other; repeated rows and ties fall into one
component, named by its smallest doc_id; rows with a null doc_id keep their fingerprint and may have a component of
null only when no other row is in it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.shared import collected_filter, mixed, power_of_two, read, spread, stage_table, through_python

SHINGLE, DISTANCE, BUCKET = 3, 2, 64
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: The share of documents that tells which shingles are common, and the most shingles that are told apart from rare ones.
ORDER_SHARE, ORDER_SHINGLES = 0.125, 1 << 18
#: Members of a shingle's small group in expectation, and how many times they are dealt.
GROUP, DEALS = 4, 3
#: Bits of a text's parities; shingles carry them folded to fewer.
PARITY_BITS, FOLDED_BITS = 1024, 256
#: Most bits of the filter that tells which texts are needed (1 MB); beyond it more texts move than are needed.
MOST_BITS = 1 << 23
BITS, SEED = 64, 42
#: Fingerprints whose variants one task makes.
SPREAD_ROWS = 10_000
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0
    rows = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return majority(np.array([digest(join(x), SEED) for x in rows], "<u8"))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return through_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _bit(position):
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """All links a, b between different fingerprints (column fp, no repeats), or for crowded variants links that join the same fingerprints."""
    n_segments = distance // 2 + 1
    edges = [BITS * i // n_segments for i in range(n_segments + 1)]
    masks = [_signed((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    fp, p = F.col("fp"), F.col("p")
    # variants 0..63 leave out one bit of its segment, variants from 64 on are the segments themselves
    segment = reduce(lambda rest, i: F.when(p < edges[i + 1], F.lit(masks[i])).otherwise(rest), range(n_segments - 2, -1, -1), F.lit(masks[-1]))
    whole = reduce(lambda rest, i: F.when(p == BITS + i, F.lit(masks[i])).otherwise(rest), range(n_segments), segment)
    wild = p < BITS
    variants = spread(prints, "fp", SPREAD_ROWS).select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS + n_segments - 1))).alias("p")).select(
        "fp", p.cast("byte").alias("p"), fp.bitwiseAND(whole).bitwiseAND(F.when(wild, F.bitwise_not(_bit(p % BITS))).otherwise(F.lit(-1).cast("long"))).alias("v"), (wild & (fp.bitwiseAND(_bit(p % BITS)) != 0)).alias("one"))
    counts = variants.groupBy("p", "v").agg(F.count_if(~F.col("one")).alias("zeros"), F.count_if("one").alias("ones"))
    zeros, ones = F.col("zeros"), F.col("ones")
    # two fingerprints meet where they differ in the wildcard, or else in the segment that they share whole
    counts = counts.filter(F.when(wild, (zeros > 0) & (ones > 0)).otherwise(zeros > 1)).withColumn("crowded", F.when(wild, zeros.cast("double") * ones > bucket * (zeros + ones)).otherwise(zeros > 2 * bucket))
    counts = stage_table(counts.select("p", "v", "crowded"), "simhash-counts", whole=True)
    held = stage_table(variants.join(counts, ["p", "v"]), "simhash-variants", whole=True)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    few = held.filter("not crowded")
    left = few.filter(~F.col("one")).select("p", "v", fp.alias("a"))
    right = few.filter(F.col("one") | ~wild).select(p.alias("q"), F.col("v").alias("w"), fp.alias("b"))
    meet = (F.col("p") == F.col("q")) & (F.col("v") == F.col("w")) & ((F.col("p") < BITS) | (F.col("a") < F.col("b"))) & close
    pairs = left.join(right, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_bits = held.filter("crowded").select("fp").distinct().repartition(fp).select("fp", F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("i"))
    for k in range(distance):
        open_bits = open_bits.select("fp", "mask", F.explode(F.sequence(F.col("i") + 1, F.lit(BITS - distance + k))).alias("i")).select("fp", F.col("mask").bitwiseOR(_bit(F.col("i"))).alias("mask"), "i")
    groups = open_bits.groupBy("mask", fp.bitwiseAND(F.bitwise_not(F.col("mask"))).alias("v")).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("all")).filter("n > 1")
    stars = groups.select("a", F.explode("all").alias("b")).filter("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    prints = stage_table(fingerprints(docs, shingle), "simhash-prints", whole=True)
    nodes = stage_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(stage_table(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components"), "root").select("fp", "component_id")
    return prints.join(named, "fp")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The distinct shingles of SIMILAR_SHINGLE words as sorted unsigned hashes; none for fewer words."""
    n = len(words) - SIMILAR_SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, SEED) for w in words], np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(SIMILAR_SHINGLE):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mixed(sums))


def prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest hashes, so many that texts of that similarity have one of them in common. common is sorted; ties by hash."""
    if not len(hashes):
        return hashes
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    return hashes[np.argsort(rank, kind="stable")][: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as signed longs: whether an odd number of the hashes falls on each."""
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text in b.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(_words(text.as_py())).view(np.int64))], names=["h"])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the documents, and how often. They only order the shingles: any order gives the same links."""
    seen = through_python(docs.sample(ORDER_SHARE, SEED).select("text"), _shingles, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = seen.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(batches: Iterator[pa.RecordBatch], common: np.ndarray, ranks: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same, sizes, prints, first, odd = [], [], [], [], []
        for text in b.column("text"):
            words = _words(text.as_py())
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            # with fewer words than a shingle has, only equal texts are similar
            hashes = shingle_hashes(words)
            sizes.append(len(hashes))
            prints.append(_signed(majority(hashes)))
            odd.append(parities(hashes))
            first.append(prefix(hashes, common, ranks, similarity).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "same", "size", "fp", "prefix", "odd"])


def shingle_similarity(a: list[bytes], b: list[bytes], shingle: int = SIMILAR_SHINGLE) -> float:
    """Jaccard similarity of the shingle sets; a text of fewer words is one shingle."""
    x, y = (set(zip(*(w[i:] for i in range(shingle)), strict=False)) or {tuple(w)} for w in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [shingle_similarity(_words(x.as_py()), _words(y.as_py())) >= similarity for x, y in zip(b.column("text_a"), b.column("text_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])


def _needed(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(b.column("doc_id").is_valid())
        yield b.filter(pa.array(held.value.has(b.column("doc_id").to_numpy().view(np.uint64))))


def _even(size_a: str, odd_a: str, size_b: str, odd_b: str, n_bits: int, similarity: float):
    """Whether parities allow the similarity: shingles that only one has are at most (1 - s) / (1 + s) of the sizes' sum."""
    bits = reduce(lambda n, i: n + F.bit_count(F.col(odd_a)[i].bitwiseXOR(F.col(odd_b)[i])), range(n_bits // 64), F.lit(0))
    return bits <= (1 - similarity) / (1 + similarity) * (F.col(size_a) + F.col(size_b)) + 1e-6


def _compared(docs: DataFrame, lists: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose whole texts are similar.

    lists: node, size, odd (parities), all (its prefix shingles that others have too). Up to the end of the prefix that ends
    first the shared shingles are known; from there the texts have no more in common than the one with fewer shingles left
    has. Only pairs that this and their parities allow load their texts.
    """
    spark = docs.sparkSession
    near = stage_table(pairs, "similar-pairs")
    for end in ("a", "b"):
        near = near.join(lists.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("odd").alias(f"odd_{end}"), F.col("all").alias(f"all_{end}")), end)
    left = [F.ceil(similarity * F.col(f"size_{end}") - 1e-9) - 1 for end in ("a", "b")]  # shingles behind the prefix
    both = F.size(F.array_intersect("all_a", "all_b")) + F.greatest(*left)
    near = near.filter(_even("size_a", "odd_a", "size_b", "odd_b", PARITY_BITS, similarity))
    near = stage_table(near.filter(both >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6).select("a", "b"), "similar-open-pairs")
    used = stage_table(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct(), "similar-used")
    held = spark.sparkContext.broadcast(collected_filter(used.select(F.col("doc_id").alias("h")), power_of_two(16 * used.count(), 1 << 12, MOST_BITS)))
    texts = stage_table(through_python(docs.select("doc_id", "text"), lambda it: _needed(it, held), "doc_id long, text string").join(used, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "similar-texts", whole=True)
    both = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return stage_table(through_python(both, lambda it: _similar(it, similarity), "a long, b long"), "similar-links")


def _signature_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of texts whose fingerprints are equal or linked; of equal ones each with the smallest."""
    first = stage_table(nodes.groupBy("fp").agg(F.min("node").alias("first")), "similar-fps", whole=True)
    equal = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"))
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    return equal.unionByName(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def _fit(similarity: float):
    """Whether sizes, and the places of a hash in both prefixes, still allow the similarity."""
    n, m = F.col("x.size"), F.col("y.size")
    rest = 1 + F.least(n - 1 - F.col("x.at"), m - 1 - F.col("y.at"))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (rest >= similarity / (1 + similarity) * (n + m) - 1e-6)


def _first_pairs(held: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of members of a hash that more than GROUP have, and the smallest member of the small group that each is dealt to."""
    deal = F.explode(F.sequence(F.lit(1), F.lit(DEALS)))
    many = held.filter(F.col("members") > GROUP).withColumn("deal", deal)
    many = many.select("node", "size", F.struct("h", "deal", F.pmod(F.xxhash64("deal", "node", "h"), F.ceil(F.col("members") / GROUP))).alias("group"))
    first = stage_table(many.groupBy("group").agg(F.min(F.struct("node", "size")).alias("lo")).select("group", "lo.*"), "similar-firsts")
    sizes = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6  # the shingle need not be the first that two share
    met = many.alias("x").join(first.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.node") > F.col("y.node")) & sizes)
    return met.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))


def _across(held: DataFrame, lists: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs a, b that share a hash and are not connected yet: one of the two is outside the hash's largest component."""
    now = stage_table(held.join(roots, "node", "left").select("h", "node", "size", "at", F.coalesce("root", "node").alias("component")), "similar-members", whole=True)
    sizes = now.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    most = stage_table(sizes.groupBy("h").agg(F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("n", "component")).alias("most")).filter("components > 1").select("h", "most"), "similar-most")
    n = FOLDED_BITS // 64
    folded = F.array(*(reduce(lambda x, y: x.bitwiseXOR(y), (F.col("odd")[k] for k in range(i, PARITY_BITS // 64, n))) for i in range(n)))
    open_ = stage_table(now.join(most, "h").join(lists.select("node", folded.alias("odd")), "node"), "similar-open", whole=True)
    left, right = open_.filter("component <> most").alias("x"), open_.alias("y")
    # two outside the largest component meet once, from the smaller node
    once = (F.col("y.component") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    met = left.join(right, (F.col("x.h") == F.col("y.h")) & (F.col("x.component") != F.col("y.component")) & once & _fit(similarity) & _even("x.size", "x.odd", "y.size", "y.odd", FOLDED_BITS, similarity))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: equal texts (but for white space and A-Z), and chains of documents with that similarity of shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common, ranks = _common(docs)
    prints = stage_table(through_python(docs, lambda it: _prefixes(it, common, ranks, similarity), "doc_id long, same binary, size int, fp long, prefix array<long>, odd array<long>"), "similar-prints", whole=True)
    nodes = stage_table(prints.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd")), "similar-nodes", whole=True)
    some = nodes.filter("node is not null and size > 0")
    rows = some.select("node", "size", F.posexplode("prefix").alias("at", "h"))
    shared = stage_table(rows.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "similar-shared", whole=True)
    held = stage_table(rows.join(shared, "h"), "similar-held", whole=True)
    lists = stage_table(held.groupBy("node").agg(F.first("size").alias("size"), F.collect_list("h").alias("all")).join(some.select("node", "odd"), "node"), "similar-lists", whole=True)
    # most of a large group hangs together by its signatures and the small groups of its shingles; what is connected by then need not meet
    found = _compared(docs, lists, _signature_pairs(some.select("node", "fp")).unionByName(_first_pairs(held, similarity)).distinct(), similarity)
    roots = stage_table(components(found), "similar-roots")
    found = _compared(docs, lists, _across(held, lists, roots, similarity), similarity)
    for end in ("a", "b"):  # links between the components found so far
        found = found.join(roots.select(F.col("node").alias(end), "root"), end, "left").select(F.coalesce("root", end).alias(end), "b" if end == "a" else "a")
    tops = components(found.distinct()).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = nodes.select("same", "node").join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    named = named.join(tops, "root", "left").select("same", F.coalesce("top", "root").alias("component_id"))
    return prints.select("doc_id", "same").join(stage_table(named, "similar-named"), "same").select("doc_id", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

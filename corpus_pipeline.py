"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes the session, the documents that the stage before kept and the folder of the tables, and returns the
documents that it keeps with the columns doc_id, text, lang, source, n_chars; the last returns packed pieces. `run`
writes each stage's result to the folder that the executors share and reads it again.

SQL can express neither the language model nor packing, so ORACLE_SQL is None and the tests hold every stage against a
plain one.

Null and empty texts have no letter, so the first stage drops them; later stages take a null text for an empty one. Rows
with null or repeated doc_id are rows like any others: line dedup counts rows that share a doc_id as one document and lets
those without one alone; near-dedup and decontamination decide by a written row number. Ties go to the smallest doc_id, then
the first row. Empty tables give no rows, columns that are not in COLUMNS are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, language_id, line_dedup, packing, shared, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents under this share of the likelihood of all languages are of no certain language.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a known language: those with letters whose best language is likelier than not."""
    found = language_id.identify(docs, language_id.fit(docs), COLUMNS)
    return found.filter((F.col("lang_pred") != language_id.UND) & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that an earlier document has; documents stay, with n_chars of what is left."""
    return line_dedup.line_dedup(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a written number `row`, as doc_id may be null or repeated."""
    return shared.stage_table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered", whole=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal or similar ones (five-word shingles, 0.8 or more): of the smallest doc_id, null being the greatest."""
    docs = _numbered(docs)
    since = shared.mark()
    named = shared.finish(simhash.similar_documents(docs.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row"), "near-rows", since)
    many = named.filter("row <> component_id").select("component_id").distinct()
    groups = shared.stage_table(named.join(many, "component_id").join(docs.select("row", "doc_id"), "row"), "near-groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("component_id", F.col("first.row").alias("kept"))
    gone = shared.stage_table(groups.join(first, "component_id").filter("row <> kept").select("row"), "near-duplicates")
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark."""
    docs = _numbered(docs)
    since = shared.mark()
    found = decontamination.contamination(docs.select(F.col("row").alias("doc_id"), "text"), shared.read(spark, sf_dir, "benchmark"))
    gone = shared.finish(found.filter("n_hit > 0").select(F.col("doc_id").alias("row")), "contaminated", since)
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row into sequences, a null text as an empty one; rows that share a doc_id each have their own pieces."""
    return packing.digest(packing.pack(docs))


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("simhash", drop_near_duplicates), ("decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; what a stage wrote for itself goes with it."""
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = shared.mark()
        docs = shared.finish(stage(spark, docs, sf_dir), f"pipeline-{name}", since, whole=True)
    return STAGES[-1][1](spark, docs, sf_dir)

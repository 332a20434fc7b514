"""The corpus pipeline: five stages over documents, each one operator of ``quantloom.llm`` whose decisions take effect.

Language ID drops documents in no language, the n-gram join keeps the first document of each group of near
duplicates, decontamination drops documents that overlap benchmark items, PII spans are replaced by their kind, and what is
left is packed into token sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontamination, language_id, ngram_join, packing, pii
from quantloom.llm.common import read, row_key, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null, empty and letterless texts go. Each row is judged by its text, repeated ones and those without doc_id too."""
    learned = stash(language_id.profiles(docs), "profiles")
    return language_id.identify(docs.select(*COLUMNS), learned).where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, with the smallest doc_id; of rows that share it, the first by their columns.

    Rows without doc_id take part: a component of only such rows keeps one. Null, empty and wordless texts link with nothing, so each
    doc_id keeps one of its rows and those without doc_id all stay.
    """
    first = ngram_join.first_of_groups(docs).groupBy("key").agg(F.min(F.col("key") == F.col("component_id")).alias("stays"), F.max("named").alias("named"), F.max("n_shingles").alias("size"), F.count("*").alias("rows"))
    several = F.expr("stays and rows > 1 and (named or size > 0)")
    judged = stash(first.select("key", "stays", several.alias("several")), "judged")
    gone, several = (stash(judged.where(c).select("key"), name) for c, name in (("not stays or several", "gone"), ("several", "several")))
    rows = docs.select(*COLUMNS, row_key().alias("key"))
    kept = rows.join(gone, "key", "left_anti").select(*COLUMNS)
    if several.isEmpty():
        return kept
    return kept.unionByName(rows.join(several, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without overlap with a benchmark item; null and empty texts stay.

    A document is all rows of one doc_id: if one of them overlaps, all go. Rows without doc_id are told apart by their texts, so equal ones share their fate.
    """
    rows = docs.withColumn("key", row_key())
    found = decontamination.overlaps(rows.select(F.col("key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(stash(found, "overlaps"), "key", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, repeated ones and those without doc_id too, personal data replaced; n_chars follows the text. A null text stays null."""
    return pii.redact(docs, pii.train(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row in sequences; the columns of the packing operator. A null or empty text is its end token alone; repeated rows are packed each."""
    return packing.pack(docs, packing.tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("ngram_jaccard_join", keep_first_of_group),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

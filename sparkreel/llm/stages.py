"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all of ``docs`` and, but for the last, returns columns of documents.

A stage drops rows or changes texts; what it keeps stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkreel.llm import decontamination, near_duplicates, packing, personal_data, toxicity
from sparkreel.llm.queries import toxicity_model
from sparkreel.llm.records import read, transcripts

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores from here on are toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the transcripts that score as toxic. The texts ride along with their scores, so nothing is joined."""
    model = toxicity_model(spark, docs, sf_dir)
    packed = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("video_id"), F.col("text").alias("transcript"))
    kept = toxicity.score_toxicity(packed, model, fitted=True).filter(F.col("score") < TOXIC)
    return kept.select("video_id.*", F.col("transcript").alias("text")).select(DOCUMENT)


def _row() -> Column:
    """What tells rows apart whose doc_id is NULL or repeats: 128 hash bits of all columns behind the doc_id, so that the smallest is
    that of the smallest doc_id. Only rows that are equal in all columns share it."""
    flagged = [x for c in DOCUMENT for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", *[F.xxhash64(F.lit(k), *flagged).alias(f"hash{k}") for k in (1, 2)])


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``_row`` is a video_id of ``found``."""
    gone = found.select("video_id.hash1", "video_id.hash2").distinct()
    return docs.select(*DOCUMENT, _row().alias("_row")).join(
        gone, (F.col("_row.hash1") == gone.hash1) & (F.col("_row.hash2") == gone.hash2), "left_anti").select(DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, or any of several rows of that id. Rows are
    dropped one by one, whatever their doc_id; of rows that are equal in all columns one stays."""
    rows = docs.select(_row().alias("video_id"), F.col("text").alias("transcript"))
    groups = near_duplicates.near_duplicates(rows, words=5)
    return _without(docs, groups.filter("NOT kept")).dropDuplicates(DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item; others of the same doc_id, or without one, stay."""
    held_out = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip_id"), "text")
    rows = docs.select(_row().alias("video_id"), F.col("text").alias("transcript"))
    return _without(docs, decontamination.contaminated(rows, held_out))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    models = personal_data.fit(transcripts(docs))
    packed = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("video_id"), F.col("text").alias("transcript"))
    found = personal_data.find_personal_data(packed, models)
    clean = personal_data.redacted(F.col("transcript"), F.col("spans"))
    return found.select("video_id.*", clean.alias("text"), F.size("spans").alias("_n")).select(
        "doc_id", "text", "lang", "source", F.when(F.col("_n") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token windows."""
    return packing.pack(transcripts(docs)).select(
        F.col("video_id").alias("doc_id"), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), F.col("window_id").alias("sequence_id"), "offset")

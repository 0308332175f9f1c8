"""Scoring of candidate tables: the pluggable scorer, the arm table and the full score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import scoring

Scorer = Callable[[DataFrame], DataFrame]


def arm_table(spark: SparkSession) -> DataFrame:
    """(variant_id, scoring_version, prompt_version, weight_version, weights): one row per arm."""
    rows = [(arm, *spec) for arm, spec in lx.ARMS.items()]
    return spark.createDataFrame(
        rows, "variant_id string, scoring_version string, prompt_version string, weight_version string, weights map<string,double>")


def title_scorer(df: DataFrame) -> DataFrame:
    """The built-in scorer: factor values from the title alone."""
    return df.withColumn("detailed_scores", scoring.mock_scores(F.col("title")))


def score(df: DataFrame, scorer: Scorer = title_scorer) -> DataFrame:
    """Score every candidate with ``scorer``, which adds ``detailed_scores`` and leaves it NULL where it fails.

    Such rows are marked ``failed`` and get the built-in values of their title, or of the word Fallback where they have none.
    """
    scored = scorer(df).withColumn("failed", F.col("detailed_scores").isNull())
    return scored.withColumn("detailed_scores", F.coalesce("detailed_scores", scoring.mock_scores(F.coalesce("title", F.lit("Fallback")))))


def score_candidates(df: DataFrame, scorer: Scorer = title_scorer, text: str = "text") -> DataFrame:
    """``score`` and ``with_virality`` in one: the text's adjustments count only where the scorer did not fail."""
    scored = score(df, scorer).withColumn("_text", F.when(F.col("failed"), "").otherwise(F.col(text)))
    return with_virality(scored, "_text").drop("_text")


def assign_variant(df: DataFrame, arms: DataFrame, id_column: str = "clip_id") -> DataFrame:
    """Arm and its versions per clip, the same on every run."""
    return df.withColumn("variant_id", scoring.arm_of(F.col(id_column))).join(arms, "variant_id")


def with_virality(df: DataFrame, text: str = "text") -> DataFrame:
    """Adjusted factors (``adjusted``) and the weighted score of the whole clip text."""
    return df.withColumn("adjusted", scoring.adjusted_scores(F.col(text), F.col("detailed_scores"))).withColumn(
        "virality_score", scoring.virality(F.col("adjusted")))

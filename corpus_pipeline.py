"""From raw documents to packed training sequences: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkreel.llm import stages
from sparkreel.llm.records import read
from sparkreel.session import new_folder

STAGES = [("toxicity", stages.drop_toxic), ("near_duplicates", stages.drop_near_duplicates), ("decontamination", stages.drop_contaminated),
          ("personal_data", stages.redact_personal_data), ("packing", stages.pack_sequences)]

#: The toxicity and retrieval stages rest on models, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; each stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

"""Stage tables: results of a processing step that a later run can take up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STAGES = ["scout", "scored", "curated", "refined"]


def save_stage(df: DataFrame, path: str, stage: str) -> None:
    """Write the rows of one stage; only the partitions present in ``df`` (checkpoint_key) are replaced."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    df.withColumn("stage", F.lit(stage)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "checkpoint_key", "stage").parquet(path)


def load_stage(spark: SparkSession, path: str, stage: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows of a stage, of the wanted checkpoint keys only; both are partition filters."""
    rows = spark.read.parquet(path).where(F.col("stage") == stage).drop("stage")
    return rows if keys is None else rows.join(keys.select("checkpoint_key").distinct(), "checkpoint_key", "left_semi")


def clear_stages(spark: SparkSession, path: str, video_id: str) -> int:
    """Delete every stage of a video (all keys that begin with ``video_id_``); returns how many keys went."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop.Path(root, f"checkpoint_key={video_id}_*")) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)

"""The library's records as the operators here see them, taken from the given tables.

A document is the transcript of one video: ``transcripts(video_id, transcript)``. A page is where a clip was published:
``uploads(clip_id, youtube_url)``. Only the named columns are read, so extra columns, whatever their names, are never in the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(docs: DataFrame) -> DataFrame:
    """transcripts(video_id, transcript) from rows of ``documents``."""
    return docs.select(F.col("doc_id").alias("video_id"), F.col("text").alias("transcript"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where it is used inside lambdas and where the optimizer merges projections."""
    return F.element_at(F.transform(F.array(value), then), 1)


def as_long(hex_digits: Column) -> Column:
    """The number written by up to 15 hexadecimal digits."""
    return F.conv(hex_digits, 16, 10).cast("bigint")

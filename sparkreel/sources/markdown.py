"""Reports as Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _cell(name: str, kind: str) -> Column:
    shown = F.format_string("%.4f", F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")
    return F.when(F.col(name).isNull(), "").otherwise(shown)


def markdown_lines(df: DataFrame) -> DataFrame:
    """``(line)``: one Markdown table row per row of a report, of any length, to be written as text files below ``markdown_head``."""
    cells = [_cell(name, kind) for name, kind in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)


def write_report(df: DataFrame, folder: str) -> None:
    """A whole report as text files: ``head`` and, in the order of ``df``, ``rows``, written by as many tasks as it has partitions."""
    df.sparkSession.createDataFrame([(line,) for line in markdown_head(df).split("\n")], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/head")
    markdown_lines(df).write.mode("overwrite").text(f"{folder}/rows")


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a written report: (line)."""
    return spark.read.text(f"{folder}/rows").withColumnRenamed("value", "line")


def markdown_table(df: DataFrame, rows: int = 1000) -> str:
    """The first ``rows`` rows of a report as a Markdown table, for showing; the whole report is written by ``markdown_lines``."""
    return "\n".join([markdown_head(df), *[r.line for r in markdown_lines(df).take(rows)]])

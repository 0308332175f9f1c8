"""Numbers and events out of tool logs and subtitle scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkreel.functions import text as tx

# Code point ranges of emoji.
EMOJI = "[\\x{1F300}-\\x{1F6FF}\\x{2600}-\\x{27BF}\\x{1F900}-\\x{1F9FF}\\x{1FA70}-\\x{1FAFF}]"


def _readings(log: str, unit: str) -> tuple[Column, Column]:
    """Names and numbers of all ``name: number unit`` readings of a log, in order."""
    pattern = F.lit(rf"(\w+): *(-?[0-9.]+) *{unit}")
    return F.regexp_extract_all(log, pattern, F.lit(1)), F.regexp_extract_all(log, pattern, F.lit(2))


def read_loudness(df: DataFrame, log: str = "log") -> DataFrame:
    """Mean and peak volume in dB, -15 and 0 where the log has none."""
    names, values = _readings(log, "dB")

    def level(name: str, default: float) -> Column:
        found = F.get(values, (F.array_position(names, name) - 1).cast("int"))
        return F.coalesce(found.try_cast("double"), F.lit(default)).alias(name)
    return df.select("*", level("mean_volume", -15.0), level("max_volume", 0.0))


def read_silences(df: DataFrame, log: str = "log", offset: str = "scan_start") -> DataFrame:
    """One row per silence start, in absolute seconds."""
    names, values = _readings(log, "")
    found = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda x: x["name"] == "silence_start")
    rows = df.select("*", F.explode(F.transform(found, lambda x: x["value"])).alias("_t"))
    return rows.withColumn("t", F.col(offset) + F.col("_t").try_cast("double")).where("t IS NOT NULL").drop("_t")


def parse_ass_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Start, end, plain text, first highlighted word and emoji of every dialogue line."""
    # Nine fields come before the text, which may hold commas itself, also as its first character.
    # As a generator, not as a filter: a filter is pushed below the line's own expression, which is then evaluated once more per use.
    fields = F.split(F.expr(f"substring(ltrim({line}), 10)"), ",", 10)
    whole = F.filter(F.array(fields), lambda f: F.size(f) == 10)
    rows = lines.select("*", F.explode(F.when(F.ltrim(line).startswith("Dialogue:"), whole)).alias("_f")).withColumns({
        "_text": F.col("_f")[9], "start": tx.parse_ass_clock(F.col("_f")[1]), "end": tx.parse_ass_clock(F.col("_f")[2])}).drop("_f")
    colour = r"\{\\c&H[a-fA-F0-9]+&\}"
    plain = tx.strip(F.regexp_replace("_text", r"\{[^}]+\}", ""))
    rows = rows.withColumns({"highlight": F.regexp_extract("_text", rf"{colour}([^{{]+){colour}", 1), "text": plain})
    return rows.withColumns({"emoji": F.array_join(F.regexp_extract_all("text", F.lit(EMOJI), F.lit(0)), ""),
                             "clean_text": tx.strip(F.regexp_replace("text", EMOJI, ""))}).drop("_text")


def read_ass_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_ass_events(spark.read.text(path)).drop("value")

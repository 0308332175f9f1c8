"""Transcripts: subtitle files, JSON caches and the choice among several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx

LINE_JSON = "array<struct<text:string,start:double,duration:double>>"
STAMP = r"\d{2}:\d{2}:\d{2}[.,]\d{3}[ \t]*-->[ \t]*\d{2}:\d{2}:\d{2}[.,]\d{3}"


def parse_subtitles(files: DataFrame, key: str = "video_id", content: str = "content") -> DataFrame:
    """(key, line_idx, text, start, duration) of every cue from WebVTT or SRT text, one row per file in.

    A file is cut before every line that holds a time stamp, all inside its row, so nothing is
    shuffled. Lines of digits only, ``WEBVTT`` and lines with ``NOTE`` are no speech; tags go, blanks
    collapse, empty cues vanish.
    """
    lines = F.transform(F.split(F.col(content), r"\r\n|\n|\r"), tx.strip)
    speech = lambda l: (l != "") & ~l.rlike(r"^\p{Nd}+$") & (l != "WEBVTT") & ~F.contains(l, F.lit("NOTE"))
    kept = F.array_join(F.filter(lines, lambda l: l.rlike(STAMP) | speech(l)), "\n")
    # Everything before the first stamp belongs to no cue.
    cues = F.filter(F.split(kept, rf"(?m)(?=^[^\n]*{STAMP})"), lambda c: c.rlike(STAMP))
    stamps = lambda c: F.regexp_extract_all(c, F.lit(r"(\d{2}:\d{2}:\d{2}[.,]\d{3})"), F.lit(1))

    def cell(c: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(c, r"^[^\n]*\n?", ""), "<[^>]+>", "")
        return F.struct(F.trim(F.regexp_replace(body, r"[ \t\n\r\f\x0B]+", " ")).alias("text"), stamps(c).alias("t"))

    # The position among the non-empty cues of a file is the line index.
    spoken = F.filter(F.transform(cues, cell), lambda l: l["text"] != "")
    rows = files.select(key, F.posexplode(spoken).alias("line_idx", "l"))
    start, end = tx.parse_clock(F.get("l.t", F.lit(0))), tx.parse_clock(F.get("l.t", F.lit(1)))
    return rows.select(key, "line_idx", F.col("l.text").alias("text"), start.alias("start"), F.greatest(F.lit(0.1), end - start).alias("duration"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files below ``path``; the file name without its suffix is the video."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1).alias("video_id"), F.col("value").alias("content"))
    return parse_subtitles(files)


def parse_transcript_json(files: DataFrame, key: str = "video_id", content: str = "content") -> DataFrame:
    """Lines of JSON transcripts (one array per row); the array position is the line index."""
    return files.select(key, F.posexplode(F.from_json(content, LINE_JSON)).alias("line_idx", "l")).select(key, "line_idx", "l.*")


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1).alias("video_id"), F.col("value").alias("content"))
    return parse_transcript_json(files)


def write_transcripts(lines: DataFrame, path: str) -> None:
    """Lines as JSON rows. Videos are spread by hash; a very long one spans several files by line block."""
    part = F.pmod(F.xxhash64("video_id", F.floor(F.col("line_idx") / 4096)), F.lit(64))
    lines.withColumn("part", part).write.mode("overwrite").partitionBy("part").json(path)


def resolve_transcript(sources: DataFrame) -> DataFrame:
    """The first source in fallback order with any lines, per video.

    ``sources`` has (video_id, tier, n_lines); tiers run 0 (cache) to 5 (speech to text). ``failures``
    are the tiers tried before, at most five; a video without any usable source has source NULL.
    """
    names = F.create_map(*[F.lit(v) for tier, name, _ in lx.TRANSCRIPT_TIERS for v in (tier, name)])
    fallback = [tier for tier, _, extra in lx.TRANSCRIPT_TIERS if extra]
    usable = F.when(F.col("n_lines") > 0, F.col("tier"))
    best = sources.groupBy("video_id").agg(F.min(usable).alias("tier"), F.array_sort(F.collect_set("tier")).alias("tried"))
    return best.select("video_id", "tier", names[F.col("tier")].alias("source"), F.filter("tried", lambda t: F.coalesce(t < F.col("tier"), F.lit(True)) & (t > 0)).alias("failures"),
                       F.coalesce(F.col("tier").isin(fallback), F.lit(False)).alias("fallback_used"))

"""Clip-analytics tables derived from the driver's tables.

Everything is lazy and covers the whole of every table: each document is a video whose text is cut
into lines of eight words, each line opens one candidate clip, each document is also one finished
clip of the video named by its source, and each user's events are the metrics of the clip with the
same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkreel.functions import scoring, text as tx

WORDS_PER_LINE = 8
LINE_SECS = 2.5
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read as it is.

    A session may set ``sparkreel.document.partitions`` where its documents lie in one file that can't be split, as on a laptop.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("sparkreel.document.partitions", None) if name == "documents" else None
    return df.repartition(int(spread), "doc_id") if spread else df


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ts)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_lines(video_id, line_idx, text, start, duration); no shuffle."""
    docs = table(spark, sf_dir, "documents")
    # Lines are matched whole, no list of words is made.
    cut = F.regexp_extract_all(tx.spaced(F.col("text")), F.lit(rf"[^ ]++(?: [^ ]++){{0,{WORDS_PER_LINE - 1}}}"), F.lit(0))
    rows = docs.select(F.concat(F.lit("v"), "doc_id").alias("video_id"), F.posexplode(cut).alias("line_idx", "text"))
    return rows.select(
        "video_id", "line_idx", "text", (F.col("line_idx") * LINE_SECS).alias("start"),
        (F.lit(2.0) + F.lit(0.125) * F.pmod(F.length("text"), F.lit(8))).alias("duration"))


def end_index() -> Column:
    """Last line of the candidate clip a line opens."""
    return (F.col("line_idx") + 3 + F.pmod(F.length("text"), F.lit(17))).cast("int").alias("end_index")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate clip per line: 4 to 20 lines long, scored from its first line."""
    src = lines(spark, sf_dir)
    return src.select(
        "video_id", F.col("line_idx").alias("ord"), F.col("text").alias("title"),
        F.col("line_idx").alias("start_index"),
        end_index(),
        scoring.weighted_score(scoring.mock_scores(F.col("text"))).alias("virality_score"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda name: F.count_if(F.col("event_type") == name)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(
        kind("view").alias("views"), kind("click").alias("likes"), kind("signup").alias("comments"),
        kind("purchase").alias("shares"), F.round(F.sum("value") / 60, 6).alias("watch_time"),
        F.round(F.least(F.lit(100.0), F.avg("value")), 6).alias("retention"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip table: one row per document with scores, metrics, creator flags and experiment arm."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    title = tx.headline(F.col("text"))
    base = docs.select("doc_id", "lang", "source", "n_chars", "text", title.alias("title"),
                       F.concat(F.lit("c"), "doc_id").alias("clip_id"), scoring.mock_scores(title).alias("detailed_scores"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (base.join(labels, "doc_id", "left").join(metrics(spark, sf_dir), "doc_id", "left").select(
        "doc_id", "clip_id", F.col("source").alias("video_id"), "title", "text", "detailed_scores",
        scoring.weighted_score(F.col("detailed_scores")).alias("virality_score"),
        zero("views"), zero("likes"), zero("comments"), zero("shares"), zero("watch_time"), zero("retention"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("creator_selected"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("creator_rejected"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("published"),
        F.when(F.col("lang") != "en", F.concat(F.lit("exp_"), "lang")).alias("experiment_id"),
        scoring.arm_of(F.col("clip_id")).alias("variant_id"),
        (F.lit(20.0) + F.pmod("n_chars", F.lit(41))).alias("duration")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric snapshots: every event is one poll of the clip with the user's number."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), "user_id").alias("clip_id"), F.col("ts").alias("snapshot_time"), "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("views"), F.col("value").alias("watch_time"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of jobs: a user is a job, an event its state at that moment."""
    status = (F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "signup", "queued").otherwise("running"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("j"), "user_id").alias("job_id"), "event_id", "ts", status.alias("status"),
        F.floor(F.col("value") / 25).cast("int").alias("progress"))


def tiled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-to-back clips of sixteen lines that cover every video completely."""
    return lines(spark, sf_dir).groupBy("video_id", F.floor(F.col("line_idx") / 16).cast("int").alias("part")).agg(
        F.min("start").alias("start_time"), F.max(F.col("start") + 2.5).alias("end_time")).select(
        "video_id", F.concat_ws("_", "video_id", "part").alias("clip_id"), "start_time", "end_time")

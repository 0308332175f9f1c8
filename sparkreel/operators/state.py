"""Current state from event tables, upserts, validation and registration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from sparkreel import lexicon as lx
from sparkreel.session import cut_lineage

METRIC_COLUMNS = ["platform", "views", "likes", "comments", "shares", "watch_time", "retention", "upload_date"]
ACTION_COLUMNS = ["selected", "rejected", "published"]


def _newest(events: DataFrame, since: DataFrame, columns: list[str], each: bool) -> DataFrame:
    """Newest values per clip after its latest metadata; ``each`` takes every column's own newest non-NULL value."""
    rows = events.join(since, "clip_id").where(F.col("ts") >= F.col("_since"))
    if each:
        aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "seq"))).alias(c) for c in columns]
        return rows.groupBy("clip_id").agg(*aggs)
    return rows.groupBy("clip_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("v")).select("clip_id", "v.*")


def current_clips(metadata: DataFrame, metrics: DataFrame, actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row per clip from append-only event tables (each with clip_id, ts, seq).

    Saving metadata replaces the row, so older metrics, actions and feedback no longer count. Metrics
    and feedback replace as a whole, an action changes only the flags it names. Events of unknown clips
    have no effect.
    """
    payload = [c for c in metadata.columns if c not in ("clip_id", "ts", "seq")]
    base = metadata.groupBy("clip_id").agg(F.max("ts").alias("_since"), F.max_by(F.struct(*payload), F.struct("ts", "seq")).alias("m"))
    since = base.select("clip_id", "_since")
    numbers = [c for c in METRIC_COLUMNS if c in metrics.columns]
    out = (base.join(_newest(metrics, since, numbers, each=False), "clip_id", "left")
           .join(_newest(actions, since, ACTION_COLUMNS, each=True), "clip_id", "left")
           .join(_newest(feedback, since, ["feedback"], each=False), "clip_id", "left"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) if c not in ("platform", "upload_date") else F.col(c) for c in numbers]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ACTION_COLUMNS]
    return out.select("clip_id", "m.*", *filled, *flags, "feedback")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of both tables. Partial aggregation keeps a hot key to one row per task."""
    rows = base.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def upsert_snapshots(base: DataFrame, new: DataFrame, version: str = "ingested") -> DataFrame:
    return upsert(base, new, ["clip_id", "snapshot_time"], version)


def upsert_transcript_metrics(base: DataFrame, new: DataFrame, version: str = "created_at") -> DataFrame:
    return upsert(base, new, ["video_id"], version)


def register_external(videos: DataFrame, matches: DataFrame) -> DataFrame:
    """Clip rows for channel videos that match no clip, with the fixed values of an outside upload."""
    return videos.join(matches.select("id"), "id", "left_anti").select(
        F.concat(F.lit("yt_"), F.left("id", F.lit(8))).alias("clip_id"), F.lit("external_uploads").alias("video_id"),
        F.lit(6.0).alias("virality_score"), F.create_map().cast("map<string,double>").alias("detailed_scores"), "title",
        F.col("title").alias("shorts_title"), F.col("desc").alias("shorts_description"),
        F.array(F.lit("external"), F.lit("youtube")).alias("shorts_tags"), F.lit(30.0).alias("duration"),
        F.lit("kinetic").alias("subtitle_style"), F.lit("custom").alias("creator_preset"), F.col("id").alias("youtube_video_id"),
        F.concat(F.lit("https://youtu.be/"), "id").alias("youtube_url"), F.lit(True).alias("published"))


def publish_update(clips: DataFrame, matches: DataFrame) -> DataFrame:
    """(clip_id, youtube_video_id, youtube_url, published) for matched clips whose entry differs.

    Where several uploads match one clip the largest id stands for it.
    """
    one = matches.groupBy("clip_id").agg(F.max("id").alias("id"))
    stale = ~F.col("youtube_video_id").eqNullSafe(F.col("id")) | ~F.coalesce("published", F.lit(False))
    return clips.join(one, "clip_id").where(stale).select(
        "clip_id", F.col("id").alias("youtube_video_id"), F.concat(F.lit("https://youtu.be/"), "id").alias("youtube_url"),
        F.lit(True).alias("published"))


def metric_errors() -> Column:
    """Names of the fields a submission violates."""
    checks = [F.when(F.col(c) < 0, F.lit(c)) for c in ("views", "likes", "comments", "shares", "watch_time", "retention")]
    checks.append(F.when(~F.col("clip_id").rlike(r"^[a-zA-Z0-9-]+$"), F.lit("clip_id")))
    checks.append(F.when(F.col("feedback").isNotNull() & ~F.col("feedback").isin(lx.FEEDBACK_VALUES), F.lit("feedback")))
    return F.array_compact(F.array(*checks))


def validate_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their ``errors``)."""
    checked = df.withColumn("errors", metric_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def is_expired(age: Column, status: Column, finished_ttl: int = 3600, running_ttl: int = 10800) -> Column:
    """Finished jobs go after an hour, others after three; without a time only finished ones go."""
    finished = status.isin("completed", "failed")
    return F.when(age.isNull(), finished).when(finished, age > finished_ttl).otherwise(age > running_ttl)


def retained(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs still inside their time to live (``created_at`` and ``now`` in epoch seconds)."""
    age = F.when(F.col("created_at") > 0, now - F.col("created_at"))
    return jobs.where(~is_expired(age, F.col("status")))


def dedup_submissions(jobs: DataFrame) -> DataFrame:
    """The active job of every video: the earliest one that has not failed (video_id, ts, seq, status)."""
    rest = [c for c in jobs.columns if c != "video_id"]
    return jobs.where("status <> 'failed' AND video_id IS NOT NULL").groupBy("video_id").agg(
        F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("j")).select("video_id", "j.*")


def _holding(finished_ttl: int, running_ttl: int, schema: pa.Schema):
    """The machine of ``hold_submissions`` over rows sorted by video and time; only the current video's state is held."""
    names = ["video_id", "job_id", "ts", "seq", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, holder, created, state = object(), None, None, None
        last: tuple | None = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "carried"])):
                name, job, ts, seq, status, carried = row
                if name != video:
                    if last:
                        out.append((*last, True))
                    video, holder, last = name, None, None
                if holder is not None:
                    age, limit = (ts - created).total_seconds(), finished_ttl if state in ("completed", "failed") else running_ttl
                    if age > limit:
                        holder = None
                if carried or (status == "queued" and (holder is None or (state == "failed" and job != holder))):
                    holder, created, state = job, ts, status
                    if not carried:
                        out.append((name, job, ts, seq, status, False))
                elif job == holder:
                    state = status
                if holder is not None:
                    last = (name, holder, created, 0, state)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*last, True), schema)], schema=schema)
    return run


def hold_submissions(events: DataFrame, held: DataFrame | None = None, finished_ttl: int = 3600, running_ttl: int = 10800) -> tuple[DataFrame, DataFrame]:
    """(submissions that start a job, who holds each video at the end), one active job per video.

    ``events(video_id, job_id, ts, seq, status)`` are submissions (``queued``) and later statuses of jobs. A submission starts a job if its
    video is free; otherwise it stands for the job that holds the video. A job holds its video from its submission on; it lets it go when
    it fails, when it is finished and older than ``finished_ttl`` seconds, or older than ``running_ttl`` in any case. ``held(video_id,
    holder, created, state)`` are the holders from before, as returned. Statuses of other jobs than the holder change nothing; rows
    without a video are left out. A video's rows are one sequence and run through one task, in constant memory.
    """
    rows = events.where("video_id IS NOT NULL").select("video_id", "job_id", "ts", "seq", "status", F.lit(False).alias("carried"))
    if held is not None:
        known = held.select("video_id", F.col("holder").alias("job_id"), F.col("created").alias("ts"), F.lit(None).cast("bigint").alias("seq"),
                            F.col("state").alias("status"), F.lit(True).alias("carried"))
        rows = rows.unionByName(known.join(rows.select("video_id").distinct(), "video_id", "left_semi"))
    kinds = StructType([*rows.select("video_id", "job_id", "ts", "seq", "status").schema, StructField("holds", BooleanType())])
    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", F.desc("carried"), "ts", "seq")
    found = cut_lineage(ordered.mapInArrow(_holding(finished_ttl, running_ttl, to_arrow_schema(kinds)), kinds))
    return (found.where("NOT holds").drop("holds"),
            found.where("holds").select("video_id", F.col("job_id").alias("holder"), F.col("ts").alias("created"), F.col("status").alias("state")))


def carry_forward(fetched: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Fetched metrics, or the previous ones where the fetch failed (``ok`` is false)."""
    old = previous.select("clip_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = fetched.join(old, "clip_id", "left")
    return joined.select("clip_id", "ok", *[
        F.when(F.col("ok"), F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns])

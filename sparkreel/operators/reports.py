"""Quality, audit, timing and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import sanitize
from sparkreel.operators.ordered import longest_run, with_neighbours


def _positions() -> Column:
    """Crop positions from a sample's frame up to before its ``next`` one."""
    def at(f: Column) -> Column:
        share = F.coalesce((f - F.col("frame")) / (F.col("next.frame") - F.col("frame")), F.lit(0.0))
        return F.floor(F.col("crop_x") * (1 - share) + F.coalesce("next.crop_x", "crop_x") * share)
    return F.transform(F.sequence(F.col("frame"), F.coalesce(F.col("next.frame") - 1, F.col("frame"))), at)


def _frozen(state: str) -> Column:
    return F.contains(F.coalesce(state, F.lit("")), F.lit("FREEZE"))


def interpolate(samples: DataFrame, block: int = 1024) -> DataFrame:
    """Whole-pixel crop position of every frame between a clip's sampled frames, linear between neighbours.

    Needs (clip_id, frame, crop_x); frames outside the sampled range do not exist.
    """
    near = with_neighbours(samples.select("clip_id", "frame", "crop_x"), ["clip_id"], F.floor(F.col("frame") / block), ["frame"],
                           ["frame", "crop_x"], previous=None)
    every = near.select("clip_id", "frame", F.posexplode(_positions()).alias("step", "crop_x"))
    return every.select("clip_id", (F.col("frame") + F.col("step")).alias("frame"), "crop_x")


def movement(frames: DataFrame, block: int = 1024) -> DataFrame:
    """Per clip the mean absolute change of crop x over its frames (the divisor counts all frames)."""
    near = with_neighbours(frames.select("clip_id", "frame", "crop_x"), ["clip_id"], F.floor(F.col("frame") / block), ["frame"],
                           ["crop_x"], following=None)
    step = F.coalesce(F.abs(F.col("crop_x") - F.col("prev.crop_x")), F.lit(0.0))
    return near.groupBy("clip_id").agg((F.sum(step) / F.count("*")).alias("avg_movement"))


def freeze_events(samples: DataFrame, block: int = 1024) -> DataFrame:
    """Per clip how often the camera state turns into a freeze."""
    near = with_neighbours(samples, ["clip_id"], F.floor(F.col("frame") / block), ["frame"], ["state"], following=None)
    return near.groupBy("clip_id").agg(F.count_if(_frozen("state") & ~_frozen("prev.state")).alias("freeze_events"))


def camera_qa(samples: DataFrame, stride: int = 3, bypass: bool = False, block: int = 1024) -> DataFrame:
    """Camera quality per clip from frame telemetry, in two passes: one over neighbouring samples, one for the longest run.

    Needs (clip_id, frame, has_face, active, face_cx, crop_x, crop_w, state, switched); frames are
    multiples of ``stride``.
    """
    inside = F.col("face_cx").between(F.col("crop_x") - 15, F.col("crop_x") + F.col("crop_w") + 15)
    near = with_neighbours(samples.select("clip_id", "frame", "crop_x", "state", "active", "switched", inside.alias("inside")), ["clip_id"],
                           F.floor(F.col("frame") / block), ["frame"], ["frame", "crop_x", "state"])
    # The camera's way from a sampled frame to the next one, frame by frame.
    way = F.concat(_positions(), F.when(F.col("next").isNotNull(), F.array(F.floor("next.crop_x"))).otherwise(F.array().cast("array<bigint>")))
    steps = F.zip_with(F.slice(way, F.lit(1), F.size(way) - 1), F.slice(way, F.lit(2), F.size(way)), lambda a, b: F.abs(b - a))
    base = near.groupBy("clip_id").agg(
        F.count_if("active").alias("active"), F.count_if(F.col("active") & F.col("inside")).alias("inside"), F.count_if("switched").alias("track_switches"),
        F.count_if(_frozen("state") & ~_frozen("prev.state")).alias("freeze_events"),
        (F.sum(F.aggregate(steps, F.lit(0).cast("bigint"), lambda t, x: t + x)) / F.sum(F.size(_positions()))).alias("avg_movement"))
    positions = samples.withColumn("frame", (F.col("frame") / stride).cast("bigint"))
    parts = base.join(longest_run(positions, ~F.col("has_face")), "clip_id")
    visible = F.when(F.col("active") > 0, F.col("inside") / F.col("active") * 100).otherwise(100.0)
    lost = F.col("longest_run") * stride
    passed = (visible >= 90.0) & (F.col("track_switches") <= 5) & (F.col("avg_movement") <= 12.0) & (lost <= 240)
    return parts.select("clip_id", F.round(visible, 2).alias("speaker_visibility_pct"), "track_switches",
                        F.round("avg_movement", 2).alias("avg_movement_per_frame"), lost.alias("max_face_lost_frames"), "freeze_events",
                        (passed | F.lit(bypass)).alias("qa_passed"))


def qa_failures(qa: DataFrame) -> DataFrame:
    """Text per failed camera threshold with its margin."""
    vis, sw, mov, lost = (F.col(c) for c in ("speaker_visibility_pct", "track_switches", "avg_movement_per_frame", "max_face_lost_frames"))
    texts = F.array_compact(F.array(
        F.when(vis < 90, F.format_string("Speaker Visibility: %.1f%% (failed threshold >= 90%% by %.1f%%)", vis, 90 - vis)),
        F.when(sw > 5, F.format_string("Track Switches: %d (failed threshold <= 5 by %d)", sw, sw - 5)),
        F.when(mov > 12, F.format_string("Average Crop Movement: %.2fpx/frame (failed threshold <= 12.0px/frame by %.2fpx/frame)", mov, mov - 12)),
        F.when(lost > 240, F.format_string("Max Consecutive Face Loss: %d frames (failed threshold <= 240 frames by %d frames)", lost, lost - 240))))
    return qa.select("clip_id", F.array_join(texts, "; ").alias("failures")).where("failures <> ''")


def boundary_quality_report(clips: DataFrame) -> DataFrame:
    """Per video and in total: clips, clean starts, clean ends, refined ends and mean completeness."""
    return clips.rollup("video_id").agg(
        F.count("*").alias("clips"), F.count_if("start_clean").alias("clean_starts"), F.count_if("end_clean").alias("clean_ends"),
        F.count_if("audio_refined").alias("refined_ends"), F.round(F.avg("story_completeness_score"), 4).alias("avg_completeness"),
        F.grouping("video_id").cast("int").alias("is_total"))


def transcript_summary(metrics: DataFrame) -> DataFrame:
    """One row: runs, fallbacks, their share, mean duration and the runs per source."""
    per = metrics.groupBy("source").agg(F.count("*").alias("n"), F.avg("duration").alias("d"), F.count_if("fallback_used").alias("f"))
    total = F.sum("n")
    return per.agg(total.alias("total_runs"), F.sum("f").alias("fallback_used_count"),
                   F.coalesce(F.round(F.try_divide(F.sum("f") * 100.0, total), 2), F.lit(0.0)).alias("fallback_usage_percent"),
                   F.coalesce(F.round(F.try_divide(F.sum(F.coalesce("d", F.lit(0.0)) * F.col("n")), total), 2), F.lit(0.0)).alias("average_transcription_time"),
                   F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_breakdown"))


def source_shares(metrics: DataFrame) -> DataFrame:
    """Runs and rounded share of every known source; an unused ``unknown`` is left out."""
    known = metrics.sparkSession.createDataFrame([(s,) for s in lx.KNOWN_SOURCES], "source string")
    counts = metrics.groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return known.join(counts, "source", "left").select(
        "source", F.coalesce("n", F.lit(0)).alias("runs"), F.coalesce(F.round(F.col("n") * 100 / total, 0), F.lit(0.0)).alias("pct")).where(
        "source <> 'unknown' OR runs > 0")


def last_sync(snapshots: DataFrame, seconds) -> DataFrame:
    return snapshots.agg(F.coalesce(F.max(seconds), F.lit(0.0)).alias("last_sync"))


def dashboard_kpis(clips: DataFrame) -> DataFrame:
    live = clips.where("published")
    return live.agg(F.coalesce(F.sum("views"), F.lit(0)).alias("total_views"), F.count("*").alias("published_count"),
                    F.coalesce(F.round(F.avg("retention"), 4), F.lit(0.0)).alias("avg_retention"))


def stage_funnel(stages: dict[str, DataFrame], scored: str = "exported") -> DataFrame:
    """(stage, clips, mean_score, skipped): how many clips each stage leaves, in the order given."""
    counts = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count("*").alias("clips"), F.round(F.avg("virality_score"), 4).alias("mean_score"))
        counts = row if counts is None else counts.unionByName(row)
    # One row a stage, so the window is small; a join would count every stage twice.
    before = F.lag("clips").over(Window.orderBy("step"))
    return counts.select("stage", "clips", "mean_score", F.coalesce(before - F.col("clips"), F.lit(0)).alias("skipped"))


def audit_rates(runs: DataFrame) -> DataFrame:
    """Success, failure, unavailable, fallback and cache shares and the readiness score (status, source, cache_hit)."""
    pct = lambda test: F.count_if(test) / F.count("*") * 100
    status = F.col("status")
    rates = runs.agg(F.count("*").alias("total_runs"), pct(status == "Success").alias("success_rate"), pct(status == "Failure").alias("failure_rate"),
                     pct(status == "unavailable").alias("unavailable_rate"),
                     pct(~F.col("source").isin("youtube_transcript_api", "cache")).alias("fallback_rate"), pct(F.col("cache_hit")).alias("cache_rate"))
    bad = F.col("failure_rate") + F.col("unavailable_rate")
    ready = F.greatest(F.lit(0.0), 100 - 1.5 * bad - 0.2 * F.col("fallback_rate"))
    names = ["success_rate", "failure_rate", "unavailable_rate", "fallback_rate", "cache_rate"]
    return rates.select("total_runs", *[F.round(c, 4).alias(c) for c in names], F.round(ready, 4).alias("readiness"))


def audit_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) of two audits of one row each."""
    names = before.columns
    long = lambda df, side: df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(side)) for c in names])).alias("m")).select("m.*")
    return long(before, "before").join(long(after, "after"), "metric").withColumn("change", F.round(F.col("after") - F.col("before"), 4))


def stage_timings(timings: DataFrame) -> DataFrame:
    """Seconds per stage and in total (stage, seconds)."""
    return timings.rollup("stage").agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.grouping("stage").cast("int").alias("is_total")).select(
        F.coalesce("stage", F.lit("total")).alias("stage"), "seconds", "is_total")


def cache_stats(events: DataFrame, hit) -> DataFrame:
    return events.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def model_comparison(runs: DataFrame) -> DataFrame:
    """Per model: runs, failures and mean time, memory and segments (model, error, elapsed, memory_mb, segments)."""
    return runs.groupBy("model").agg(
        F.count("*").alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(F.avg("elapsed"), 2).alias("elapsed_seconds"),
        F.round(F.avg(F.greatest(F.lit(0.0), "memory_mb")), 2).alias("memory_used_mb"), F.round(F.avg("segments"), 2).alias("segments"))


def caption_placement(faces: DataFrame) -> DataFrame:
    """Caption margin per clip from the 90th percentile of the face's lower edge (clip_id, face_bottom in pixels).

    Equal pixel rows are counted first, so one clip's percentile looks at no more rows than the frame has.
    """
    counted = faces.groupBy("clip_id", "face_bottom").agg(F.count("*").alias("n"))
    p90 = counted.groupBy("clip_id").agg(F.percentile("face_bottom", F.lit(0.9), F.col("n")).alias("p90"))
    return p90.select("clip_id", "p90", sanitize.caption_margin(F.col("p90")).alias("m")).select("clip_id", "p90", "m.*")

"""Clip table lookups with decoding of its JSON columns, and the wide export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EXPORT_FACTORS = ["hook_strength", "first_3_second_hook", "curiosity_gap", "emotional_intensity", "controversy", "surprise", "actionability", "storytelling"]


def decode(clips: DataFrame) -> DataFrame:
    """JSON text columns to map and arrays; malformed values become empty."""
    kinds = dict(clips.dtypes)
    out = clips
    if kinds.get("detailed_scores") == "string":
        raw = F.from_json("detailed_scores", "map<string,string>")
        numbers = F.transform_values(F.coalesce(raw, F.create_map().cast("map<string,string>")), lambda k, v: v.try_cast("double"))
        out = out.withColumn("detailed_scores", numbers)
    if kinds.get("shorts_tags") == "string":
        out = out.withColumn("shorts_tags", F.coalesce(F.from_json("shorts_tags", "array<string>"), F.array().cast("array<string>")))
    return out


def scan_clips(clips: DataFrame) -> DataFrame:
    return decode(clips)


def clips_by_video(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """Clips of the wanted videos, best first within each video."""
    return decode(clips.join(wanted.select("video_id"), "video_id", "left_semi")).orderBy("video_id", F.desc("virality_score"))


def clips_by_id(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    return decode(clips.join(wanted.select("clip_id"), "clip_id", "left_semi"))


def snapshots_of(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Snapshots of the wanted clips in time order."""
    return snapshots.join(wanted.select("clip_id"), "clip_id", "left_semi").orderBy("clip_id", "snapshot_time")


def export_frame(clips: DataFrame) -> DataFrame:
    """The 18 export columns: eight factors out of the score map, empty values for missing ones."""
    clips = decode(clips)
    factors = [F.coalesce(F.col("detailed_scores")[f].cast("string"), F.lit("")).alias(f) for f in EXPORT_FACTORS]
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    number = lambda c, zero: F.coalesce(F.col(c), F.lit(zero)).alias(c)
    return clips.select("clip_id", "virality_score", *factors, F.coalesce("feedback", F.lit("")).alias("feedback"), flag("creator_selected"),
                        flag("creator_rejected"), number("views", 0), number("likes", 0), number("comments", 0), number("watch_time", 0.0), number("retention", 0.0))


def export_csv(clips: DataFrame, path: str) -> None:
    export_frame(clips).write.mode("overwrite").csv(path, header=True)

"""Top-k, even sampling and merging of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SCORE_FIELDS = ["virality_score", "detailed_scores", "raw_llm_scores", "score_reasoning"]


def top_clips(clips: DataFrame, n: int, key: str = "video_id") -> DataFrame:
    """The ``n`` best clips per video; ties keep list order.

    Spark limits each partition to ``n`` rows per video before the shuffle, so a huge video does not
    move as a whole.
    """
    best = Window.partitionBy(key).orderBy(F.desc("virality_score"), "ord")
    return clips.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def even_sample(candidates: DataFrame, n_clips: int) -> DataFrame:
    """Evenly spread candidates: at most ``max(5, 2 * n_clips)`` positions of each video's list, ends included.

    ``ord`` is the position in the list (dense from 0), so no ranking is needed: the count per video
    gives the wanted positions and an equi-join fetches them.
    """
    k = max(5, 2 * n_clips)
    sizes = candidates.groupBy("video_id").agg(F.count("*").alias("n"))
    spot = lambda i: F.bround(i * (F.col("n") - 1) / F.lit(k - 1)).cast("int")
    wanted = F.when(F.col("n") > k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), spot)))
    picked = sizes.withColumn("picks", wanted).where("picks IS NOT NULL").select("video_id", F.explode("picks").alias("ord"))
    whole = sizes.where(F.col("n") <= k).select("video_id")
    return candidates.join(picked, ["video_id", "ord"], "left_semi").unionByName(candidates.join(whole, "video_id", "left_semi"))


def merge_selection(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Selected clips completed from the candidate with the same lines (the first one in list order).

    Fields of the selection win, except scores; a selection without a candidate stays as it is.
    """
    on = ["video_id", "start_index", "end_index"]
    known = [c for c in candidates.columns if c not in on]
    first = candidates.groupBy(*on).agg(F.min_by(F.struct(*known), "ord").alias("cand"))
    cells = []
    for c in [c for c in selected.columns if c not in on]:
        if c not in known:
            cells.append(F.col(c))
        elif c in SCORE_FIELDS:
            cells.append(F.when(F.col("cand").isNotNull(), F.col(f"cand.{c}")).otherwise(F.col(c)).alias(c))
        else:
            cells.append(F.coalesce(F.col(c), F.col(f"cand.{c}")).alias(c))
    cells += [F.col(f"cand.{c}").alias(c) for c in known if c not in selected.columns]
    return selected.join(first, on, "left").select(*on, *cells)


def chunk_transcript(lines: DataFrame, size: int = 300) -> DataFrame:
    """(video_id, chunk, text): labelled lines in batches of ``size``."""
    from sparkreel.functions.text import line_label
    label = line_label(F.col("line_idx"), F.col("start"), F.col("start") + F.col("duration"), F.trim("text"))
    return lines.groupBy("video_id", F.floor(F.col("line_idx") / size).cast("int").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", label.alias("label")))),
                                 lambda c: c["label"]), "\n").alias("text"))


def limit_minutes(lines: DataFrame, videos: DataFrame, seconds: float = 600.0) -> DataFrame:
    """For the listed videos only the lines that start before ``seconds``; other videos stay whole."""
    listed = videos.select("video_id").distinct().withColumn("_listed", F.lit(True))
    return lines.join(listed, "video_id", "left").where(F.col("_listed").isNull() | (F.col("start") < seconds)).drop("_listed")


def spread_by_score(clips: DataFrame) -> DataFrame:
    """Clips in report order: by video, then score."""
    return clips.orderBy("video_id", F.desc("virality_score"), "ord")

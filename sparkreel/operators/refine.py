"""Clip boundaries: sentence alignment, duration limits, completeness.

A clip only ever looks at lines within 58 seconds of its start. The transcript is therefore cut once
into overlapping windows of three 64-second tiles, and each clip is joined to the one window of its
start tile. Line starts are taken to be non-decreasing; line ends need not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkreel import lexicon as lx
from sparkreel.functions import sanitize, scoring, text as tx
from sparkreel.operators.joins import clip_text, nearest_line, snap_to_silence
from sparkreel.operators.ordered import with_neighbours

TILE = 64.0
LINE = ["idx", "start", "end", "hook", "bad_start", "blank", "ends", "prev_ends"]


def video_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("video_id").agg((F.max("line_idx") + 1).alias("n_lines"),
                                         F.max_by(F.col("start") + F.col("duration"), "line_idx").alias("video_end"))


def line_flags(lines: DataFrame) -> DataFrame:
    """Per line what boundary rules ask about it and about its predecessor."""
    text = F.col("text")
    base = lines.select("video_id", F.col("line_idx").alias("idx"), "start", (F.col("start") + F.col("duration")).alias("end"), "text")

    def flagged(df: DataFrame) -> DataFrame:
        return df.withColumns({"hook": tx.is_hook(text), "bad_start": ~tx.opens_cleanly(text), "blank": tx.is_blank(text),
                               "ends": tx.ends_sentence(text)}).drop("text")

    near = with_neighbours(base, ["video_id"], F.floor(F.col("idx") / 4096), ["idx"], LINE[:-1], derive=flagged)
    return near.withColumn("prev_ends", F.coalesce(F.col("prev.ends"), F.col("idx") == 0))


def line_windows(flags: DataFrame) -> DataFrame:
    """(video_id, tile, w): lines of the tile and of both neighbours in order, plus one line beyond each side."""
    tile = F.floor(F.col("start") / TILE)
    cells = F.struct(*LINE)
    beyond = lambda side: F.when(F.col(side).isNotNull(), F.struct(
        *[F.col(side)[c].alias(c) for c in LINE[:-1]], F.lit(False).alias("prev_ends")))
    copies = flags.select("video_id", F.explode(F.array(tile - 1, tile, tile + 1)).alias("tile"), "idx", cells.alias("line"),
                          beyond("prev").alias("before"), beyond("next").alias("after"))
    grouped = copies.groupBy("video_id", "tile").agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.min_by("before", "idx").alias("before"),
        F.max_by("after", "idx").alias("after"))
    return grouped.select("video_id", "tile", F.array_compact(F.concat(F.array("before"), "lines", F.array("after"))).alias("w"))


def _attach(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Clips with clamped indices ``s``/``e``, the line window ``w``, its first index ``o`` and video facts."""
    flags = line_flags(lines)
    starts = flags.select("video_id", F.col("idx").alias("s"), F.floor(F.col("start") / TILE).alias("tile"))
    placed = clips.join(video_stats(lines), "video_id").withColumn(
        "s", F.greatest(F.lit(0), F.least(F.col("start_index"), F.col("n_lines") - 1))).withColumn(
        "e", F.greatest(F.col("s"), F.least(F.col("end_index"), F.col("n_lines") - 1)))
    return placed.join(starts, ["video_id", "s"]).join(line_windows(flags), ["video_id", "tile"]).withColumn("o", F.expr("w[0].idx"))


def let(steps: dict[str, str], result: str) -> Column:
    """SQL text whose named steps are evaluated once, in order, inside one expression.

    A chain of projections would say the same, but the optimizer derives constraints for every alias
    of such a chain and planning time explodes.
    """
    for name, step in reversed(steps.items()):
        result = f"get(transform(array({step}), {name} -> {result}), 0)"
    return F.expr(result)


def _refined(df: DataFrame) -> DataFrame:
    """Move ``s`` and ``e`` to sentence borders; the start stays where its line is a hook."""
    longest, shortest = lx.MAX_CLIP, lx.MIN_CLIP
    steps = {
        "stop_at": "get(w, e - o).end",
        "locked": "get(w, s - o).hook",
        # Back to the sentence start: the nearest earlier line that closes a sentence, is blank or is too far.
        "s1": f"""CASE WHEN locked THEN s ELSE coalesce(array_max(transform(
            filter(w, x -> x.idx < s AND (x.blank OR x.ends OR coalesce(stop_at - x.start > {longest}, true))), x -> x.idx)) + 1, 0) END""",
        # Back over at most five lines that open with a conjunction or filler.
        "s2": f"""CASE WHEN locked THEN s ELSE s1 - coalesce(array_min(filter(sequence(0, 4), j -> NOT (s1 - j > 0
            AND get(w, s1 - j - o).bad_start AND coalesce(stop_at - get(w, s1 - j - 1 - o).start <= {longest}, false)))), 5) END""",
        # Forward over at most three lines to a hook line that opens cleanly.
        "s3": f"""CASE WHEN locked OR get(w, s2 - o).hook THEN s2 ELSE s2 + coalesce(array_min(filter(sequence(1, 3),
            j -> s2 + j < e AND get(w, s2 + j - o).hook AND NOT get(w, s2 + j - o).bad_start
                 AND coalesce(stop_at - get(w, s2 + j - o).start >= {shortest}, true))), 0) END""",
        # On over at most six lines until a sentence closes.
        "e1": f"""e + coalesce(array_min(filter(sequence(0, 5), j -> NOT coalesce(
            e + j < n_lines - 1 AND NOT get(w, e + j - o).blank AND NOT get(w, e + j - o).ends
            AND get(w, e + j + 1 - o).end - get(w, s3 - o).start <= {longest}, false))), 6)""",
    }
    df = df.withColumn("_r", let(steps, "named_struct('s', s3, 'e', e1)"))
    return df.withColumns({"s": F.col("_r.s"), "e": F.col("_r.e")}).drop("_r")


def refine_boundaries(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Clips with ``start_index``/``end_index`` moved to sentence borders."""
    out = _refined(_attach(clips, lines))
    return out.withColumns({"start_index": F.col("s").cast("int"), "end_index": F.col("e").cast("int")}).select(*clips.columns)


def _clamped(df: DataFrame, margin: float) -> DataFrame:
    """Enforce 38..58 seconds on ``s``/``e`` and set start_time/end_time."""
    shortest, longest = lx.MIN_CLIP, lx.MAX_CLIP
    stop = lambda x: f"least({x}.end + {margin}D, video_end)"
    length = lambda line: f"coalesce({stop(f'get(w, {line} - o)')} - begin, double('inf'))"
    grown = {
        "begin": "get(w, s - o).start",
        "e1": f"""CASE WHEN {length('e')} >= {shortest} THEN e ELSE coalesce(array_min(transform(
            filter(w, x -> x.idx >= e AND {stop('x')} - begin >= {shortest}), x -> x.idx)), n_lines - 1) END""",
        "s1": f"""CASE WHEN {length('e1')} >= {shortest} THEN s ELSE coalesce(array_max(transform(
            filter(w, x -> x.idx <= s AND {stop('get(w, e1 - o)')} - x.start >= {shortest}), x -> x.idx)), 0) END""",
        "from1": "get(w, s1 - o).start",
    }
    length = lambda line: f"coalesce({stop(f'get(w, {line} - o)')} - from1, double('inf'))"
    shrunk = {
        "e2": f"""CASE WHEN {length('e1')} <= {longest} THEN e1 ELSE coalesce(array_max(transform(
            filter(w, x -> x.idx >= s1 AND x.idx < e1 AND {stop('x')} - from1 <= {longest}), x -> x.idx)), s1) END""",
        "full": stop("get(w, e2 - o)"),
        "cut": f"""CASE WHEN full - from1 < {shortest} THEN least(from1 + {lx.DEFAULT_CLIP}, video_end)
            WHEN full - from1 > {longest} THEN least(from1 + {longest}, video_end) ELSE full END""",
        # Not into the next line.
        "follow": "CASE WHEN e2 + 1 < n_lines THEN get(w, e2 + 1 - o).start END",
        "finish": "CASE WHEN follow < cut AND follow > get(w, e2 - o).start THEN follow ELSE cut END",
    }
    cells = "named_struct('s', s1, 'e', e2, 'start_time', bround(from1 * 100) / 100, 'end_time', bround(finish * 100) / 100)"
    df = df.withColumn("_r", let({**grown, **shrunk}, cells))
    return df.withColumns({c: F.col("_r")[c] for c in ("s", "e", "start_time", "end_time")}).drop("_r")


def _graded(df: DataFrame) -> DataFrame:
    at = lambda i, field: F.expr(f"get(w, {i} - o).{field}")
    df = df.withColumns({"start_clean": ~at("s", "bad_start"), "end_clean": at("e", "ends"),
                         "sentence_start": (F.col("s") == 0) | at("s", "prev_ends"), "opens_with_hook": at("s", "hook"),
                         "audio_refined": F.lit(False)})
    return df.withColumn("story_completeness_score", story_score())


QUALITY = ["start_time", "end_time", "start_clean", "end_clean", "sentence_start", "opens_with_hook", "audio_refined",
           "story_completeness_score"]


def story_score() -> Column:
    return scoring.completeness(F.col("start_clean"), F.col("sentence_start"), F.col("opens_with_hook"), F.col("end_clean"),
                                F.col("end_time") - F.col("start_time"), F.col("audio_refined"))


def refine_audio_end(clips: DataFrame, silences: DataFrame) -> DataFrame:
    """Clips of ``with_quality`` whose end moved to a silence, graded again."""
    return snap_to_silence(clips.drop("audio_refined"), silences).withColumn("story_completeness_score", story_score())


def _finish(df: DataFrame, columns: list[str], extra: list[str]) -> DataFrame:
    df = df.withColumns({"start_index": F.col("s").cast("int"), "end_index": F.col("e").cast("int")})
    return df.select(*[c for c in columns if c not in extra], *extra)


def clamp_duration(clips: DataFrame, lines: DataFrame, margin: float = lx.END_MARGIN) -> DataFrame:
    """Clips grown or shrunk to 38..58 seconds, with start_time and end_time."""
    return _finish(_clamped(_attach(clips, lines), margin), clips.columns, ["start_time", "end_time"])


def with_quality(clips: DataFrame, lines: DataFrame, refine: bool = True, margin: float = lx.END_MARGIN) -> DataFrame:
    """Refinement, clamping and boundary quality in one pass over the line windows."""
    df = _attach(clips, lines)
    df = _graded(_clamped(_refined(df) if refine else df, margin))
    return _finish(df, clips.columns, QUALITY)


def with_seo(clips: DataFrame) -> DataFrame:
    """Title, description and tags for publishing, filled where they are missing."""
    has = lambda c, kind="string": F.col(c) if c in clips.columns else F.lit(None).cast(kind)
    return clips.withColumns({
        "shorts_title": sanitize.seo_title(F.coalesce("title", F.lit("Highlighted Clip")), has("shorts_title")),
        "shorts_description": sanitize.seo_description(has("reason"), has("shorts_description")),
        "shorts_tags": sanitize.seo_tags(F.col("title"), has("shorts_tags", "array<string>"))})


def resolve_times(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Line indices for clips that carry only times: the nearest line start and the nearest line end."""
    timed = clips.withColumn("end_time", F.coalesce("end_time", F.col("start_time") + lx.DEFAULT_CLIP))
    return nearest_line(timed, lines)


def prepared_clips(candidates: DataFrame, lines: DataFrame, refine: bool = True) -> DataFrame:
    """Everything of the validation step before clips are compared with each other."""
    return clip_text(with_seo(with_quality(candidates, lines, refine)), lines)


def validate_clips(candidates: DataFrame, lines: DataFrame, refine: bool = True, block: int = 1024) -> DataFrame:
    """Refined, clamped, graded, completed and deduplicated clips."""
    from sparkreel.operators.dedup import dedup_clips
    return dedup_clips(prepared_clips(candidates, lines, refine), block)


def within_window(clips: DataFrame, adjusted: DataFrame, radius: int = 8) -> DataFrame:
    """Editor adjustments (video_id, ord, adjusted_start, adjusted_end) that stay in the window around the clip."""
    joined = clips.join(adjusted, ["video_id", "ord"], "left")
    inside = ((F.col("adjusted_start") >= F.greatest(F.lit(0), F.col("start_index") - radius))
              & (F.col("adjusted_start") <= F.col("adjusted_end"))
              & (F.col("adjusted_end") <= F.least(F.col("n_lines") - 1, F.col("end_index") + radius)))
    return joined.withColumns({
        "start_index": F.when(inside, F.col("adjusted_start")).otherwise(F.col("start_index")),
        "end_index": F.when(inside, F.col("adjusted_end")).otherwise(F.col("end_index")),
        "accepted": F.coalesce(inside, F.lit(False))}).drop("adjusted_start", "adjusted_end")

"""Range, interval, nearest and similarity joins, all as equi-joins on tiles or classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkreel import lexicon as lx
from sparkreel.functions import text as tx
from sparkreel.operators import similarity as sim
from sparkreel.operators.ordered import filled_neighbours, running_total
from sparkreel.session import cut_lineage

LINE_BLOCK = 16
TIME_TILE = 64.0
#: Lines of a tile, two of which make a clip's window, and tiles of a coarse block.
TEXT_TILE, TEXT_TILES = 64, 16
#: Seconds of a block in which times and points are ordered together.
NEAR_BLOCK = 4096.0


def lines_between(spans: DataFrame, lines: DataFrame, ids: list[str]) -> DataFrame:
    """(video_id, ids, lines ARRAY<STRUCT<line_idx, text>>): the lines ``low``..``high`` of each span in order.

    Lines travel in blocks of sixteen, so a span meets a handful of rows instead of one per line.
    """
    blocks = lines.groupBy("video_id", F.floor(F.col("line_idx") / LINE_BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("cells"))
    low = F.greatest(F.lit(0), F.col("low"))
    wanted = spans.where("high >= 0 AND high >= low").select("video_id", *ids, "low", "high", F.explode(F.sequence(
        F.floor(low / LINE_BLOCK), F.floor(F.col("high") / LINE_BLOCK))).alias("block"))
    parts = wanted.join(blocks, ["video_id", "block"]).select("video_id", *ids, "block", F.filter(
        "cells", lambda c: c["line_idx"].between(F.col("low"), F.col("high"))).alias("cells"))
    # One output cell per span: its length is the span's own length.
    joined = parts.groupBy("video_id", *ids).agg(F.sort_array(F.collect_list(F.struct("block", "cells"))).alias("all"))
    return joined.select("video_id", *ids, F.flatten(F.transform("all", lambda p: p["cells"])).alias("lines"))


def _text_of(spans: str, w: str) -> str:
    """The text of ``spans`` in ``w``, lines in order: what ``lines_between`` gathers, block by block."""
    block = lambda x: f"floor({x} / {LINE_BLOCK})"
    pieces = f"""filter(flatten(transform({spans}, s -> transform(sequence({block('s.low')}, {block('s.high')}), b -> named_struct('block', b, 'there',
        exists({w}, x -> {block('x.line_idx')} = b), 'cells', filter({w}, x -> {block('x.line_idx')} = b AND x.line_idx BETWEEN s.low AND s.high))))), p -> p.there)"""
    return f"get(transform(array({pieces}), p -> if(size(p) > 0, array_join(flatten(transform(sort_array(p), x -> x.cells)).text, ' '), NULL)), 0)"


def clip_text(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Clips with the joined text of their lines; clips of one (video_id, ord) have one text, of all their lines.

    A text is many times its clip, so clips travel to their lines and not back: lines are dealt by coarse blocks, there gathered in windows of
    two neighbouring tiles, and a clip meets the one window of its first line. Clips that reach further go through ``lines_between``.
    """
    key = ["video_id", "ord"]
    own = [c for c in clips.columns if c not in (*key, "text")]
    low, high = F.greatest(F.lit(0), F.col("start_index")), F.col("end_index")
    span = F.when((high >= 0) & (high >= F.col("start_index")), F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high")))
    rows = clips.select(*key, F.struct(*own).alias("own"), span.alias("span"))
    whole = F.col("video_id").isNotNull() & F.col("ord").isNotNull()
    # Every reader asks for ``own`` and for the same lines, so that all read one shuffle of each.
    known = rows.where(whole).groupBy(*key).agg(F.collect_list("own").alias("own"), F.sort_array(F.collect_list("span")).alias("spans")).where("size(own) > 0")
    tile = F.coalesce(F.floor(F.get("spans", F.lit(0))["low"] / TEXT_TILE), F.lit(0))
    last = F.array_max(F.transform("spans", lambda s: F.floor(s["high"] / TEXT_TILE)))
    coarse = lambda t: F.floor(t / TEXT_TILES)
    near = F.coalesce((last <= tile + 1) & (coarse(last) == coarse(tile)), F.lit(True))
    placed = known.select(*key, "own", "spans", tile.alias("at"), coarse(tile).alias("coarse"), near.alias("near"))

    at = F.floor(F.col("line_idx") / TEXT_TILE)
    dealt = lines.select("video_id", coarse(at).alias("coarse"), at.alias("tile"), "line_idx", "text").where(
        F.col("video_id").isNotNull() & F.col("coarse").isNotNull() & F.col("tile").isNotNull() & F.floor(F.col("line_idx") / LINE_BLOCK).isNotNull()).repartition(
        "video_id", "coarse")
    windows = dealt.withColumn("tile", F.explode(F.array(F.col("tile") - 1, F.col("tile")))).where(coarse(F.col("tile")) == F.col("coarse")).groupBy(
        "video_id", "coarse", "tile").agg(F.sort_array(F.collect_list(F.struct("line_idx", "text"))).alias("w")).withColumn(
        "dense", F.expr("forall(sequence(0, size(w) - 1), i -> get(w, i).line_idx = get(w, 0).line_idx + i)"))
    # Joined by the very columns both sides are dealt by, else Spark deals them again: the tile is compared only.
    here = placed.where("near").drop("near").repartition("video_id", "coarse").alias("c")
    met = here.join(windows.alias("l"), (F.col("c.video_id") == F.col("l.video_id")) & (F.col("c.coarse") == F.col("l.coarse"))
                    & (F.col("tile") <= F.col("at")) & (F.col("tile") >= F.col("at")), "left")
    # Lines that are numbered without gaps are cut out by their place.
    text = F.expr(f"""CASE WHEN w IS NULL OR size(spans) = 0 THEN NULL
        WHEN dense AND size(spans) = 1 AND spans[0].low BETWEEN w[0].line_idx AND element_at(w, -1).line_idx
        THEN array_join(slice(w, int(spans[0].low - w[0].line_idx + 1), int(least(spans[0].high - spans[0].low + 1, size(w)))).text, ' ')
        ELSE {_text_of("spans", "w")} END""")
    inside = met.select(*[F.col(f"c.{c}").alias(c) for c in key], "own", text.alias("text"))
    far = placed.where("NOT near").select(*key, "own", "spans")
    # Read from the same shuffle: an inner join, as Spark moves a semi-join to the scan.
    reach = far.select(*key, F.explode("spans").alias("s")).select(*key, "s.*")
    tiles = reach.select("video_id", F.explode(F.sequence(F.floor(F.col("low") / TEXT_TILE), F.floor(F.col("high") / TEXT_TILE))).alias("at")).distinct().withColumn(
        "coarse", coarse(F.col("at"))).repartition("video_id", "coarse").alias("c")
    few = dealt.alias("l").join(tiles, (F.col("c.video_id") == F.col("l.video_id")) & (F.col("c.coarse") == F.col("l.coarse"))
                                & (F.col("tile") <= F.col("at")) & (F.col("tile") >= F.col("at"))).select("l.*")
    beyond = lines_between(reach, few, ["ord"]).select(
        *key, F.array_join(F.transform("lines", lambda c: c["text"]), " ").alias("text"))
    texts = inside.unionByName(far.drop("spans").join(beyond, key, "left")).select(*key, F.explode("own").alias("own"), "text")
    every = texts.unionByName(rows.where(~whole).select(*key, "own", F.lit(None).cast("string").alias("text")))
    return every.select(*[c if c in key else F.col("own")[c].alias(c) for c in clips.columns if c != "text"], "text")


def context_window(clips: DataFrame, lines: DataFrame, radius: int = 8) -> DataFrame:
    """(video_id, ord, window_start, window_end, context): labelled lines around each clip."""
    spans = clips.select("video_id", "ord", (F.col("start_index") - radius).alias("low"), (F.col("end_index") + radius).alias("high"))
    labelled = lines.withColumn("text", tx.line_label(
        F.col("line_idx"), F.col("start"), F.col("start") + F.col("duration"), F.col("text")))
    around = lines_between(spans, labelled, ["ord"])
    return around.select("video_id", "ord", F.expr("lines[0].line_idx").alias("window_start"),
                         F.expr("element_at(lines, -1).line_idx").alias("window_end"),
                         F.array_join(F.transform("lines", lambda c: c["text"]), "\n").alias("context"))


def _nearest(times: DataFrame, points: DataFrame, at: str, out: str, asked: DataFrame | None = None) -> DataFrame:
    """``times`` with the idx of the point nearest to ``at``; ties go to the lowest idx, a NULL time gets NULL.

    Times and points are ordered together inside blocks of the time axis, once forwards and once backwards, so that a time meets the last
    point before and the first point after it and no list of points is built; what lies beyond a block's ends is carried from block to
    block. Times of videos without points drop out. ``asked`` names a table with the same times as ``times`` that is cheaper to read.
    """
    block = F.coalesce(F.floor(F.col("t") / NEAR_BLOCK), F.lit(0).cast("bigint")).alias("block")
    places = points.select("video_id", "t", "idx", block)
    wanted = lambda df: df.withColumn("t", F.col(at))
    point, nothing = F.struct("t", "idx"), F.lit(None)
    ends = places.groupBy("video_id", "block").agg(F.min(point).alias("first"), F.max_by(point, F.struct("t", -F.col("idx"))).alias("last"))
    edges = filled_neighbours(ends.unionByName(wanted(times if asked is None else asked).select("video_id", block).distinct(), allowMissingColumns=True).groupBy(
        "video_id", "block").agg(F.any_value("first", True).alias("first"), F.any_value("last", True).alias("last")), ["video_id"], "block")

    payload = [c for c in times.columns if c != "video_id"]
    rows = wanted(times).select("video_id", "t", block, F.struct(*payload).alias("own"), nothing.cast("double").alias("pt"), nothing.cast("int").alias("idx")).unionByName(
        places.select("video_id", "t", "block", nothing.cast(T.StructType([times.schema[c] for c in payload])).alias("own"), F.col("t").alias("pt"), "idx"))
    # Of points at one time the lowest idx comes last, in both directions; in the first one points come before times.
    near = Window.partitionBy("video_id", "block").rowsBetween(Window.unboundedPreceding, 0)
    near = {"before": near.orderBy("t", F.col("idx").desc_nulls_last()), "after": near.orderBy(F.desc("t"), F.col("idx").desc_nulls_last())}
    met = rows.select("*", *[F.last(c, True).over(w).alias(f"{side}_{c}") for side, w in near.items() for c in ("pt", "idx")]).where("own IS NOT NULL")
    both = met.join(edges, ["video_id", "block"])
    sides = [F.when(F.col(f"{side}_pt").isNotNull(), F.struct(F.col(f"{side}_pt").alias("t"), F.col(f"{side}_idx").alias("idx"))).otherwise(
        F.col(side)) for side in near]
    best = F.least(*[F.when(p.isNotNull(), F.struct(F.abs(p["t"] - F.col("t")).alias("d"), p["idx"].alias("i"))) for p in sides])
    return both.where(F.coalesce(*sides).isNotNull()).select("video_id", "own.*", F.when(F.col("t").isNotNull(), best["i"]).alias(out))


def nearest_line(times: DataFrame, lines: DataFrame) -> DataFrame:
    """Start and end times to the lines whose start and end are nearest."""
    starts = lines.select("video_id", F.col("start").alias("t"), F.col("line_idx").alias("idx"))
    ends = lines.select("video_id", (F.col("start") + F.col("duration")).alias("t"), F.col("line_idx").alias("idx"))
    return _nearest(_nearest(times, starts, "start_time", "start_index"), ends, "end_time", "end_index", times)


def words_in_clip(clips: DataFrame, words: DataFrame) -> DataFrame:
    """(video_id, clip_id, word columns): words whose time overlaps the clip's.

    Both sides are spread over the time tiles they touch; a pair is emitted in one tile only, the
    later of the two starting tiles.
    """
    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        first = F.floor(F.col(start) / TIME_TILE)
        return df.withColumn("_first", first).withColumn("_tile", F.explode(F.sequence(first, F.greatest(
            first, F.floor(F.col(end) / TIME_TILE)))))

    left = spread(clips.select("video_id", "clip_id", "start_time", "end_time"), "start_time", "end_time").withColumnRenamed("_first", "_clip_first")
    right = spread(words, "start", "end")
    return left.join(right, ["video_id", "_tile"]).where(
        (F.col("_tile") == F.greatest("_first", "_clip_first")) & (F.col("start") < F.col("end_time"))
        & (F.col("end") > F.col("start_time"))).drop("_tile", "_first", "_clip_first")


def overlap_counts(clips: DataFrame) -> DataFrame:
    """(video_id, ord, overlaps): how many other clips of the video overlap each clip in time.

    Counted from running totals of starts and ends, so no pair is ever formed: the overlapping clips
    are those that start before this one ends, less those that end before it starts.
    """
    tile = F.floor(F.col("t") / TIME_TILE)
    points = clips.select("video_id", F.explode(F.array(
        F.struct(F.col("start_time").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col("end_time").alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("p")).groupBy(
        "video_id", F.col("p.t").alias("t")).agg(F.sum("p.s").alias("s"), F.sum("p.e").alias("e")).withColumn("tile", tile)
    inside = Window.partitionBy("video_id", "tile").orderBy("t")
    across = Window.partitionBy("video_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    before = points.groupBy("video_id", "tile").agg(F.sum("s").alias("ts"), F.sum("e").alias("te")).select(
        "video_id", "tile", F.coalesce(F.sum("ts").over(across), F.lit(0)).alias("bs"), F.coalesce(F.sum("te").over(across), F.lit(0)).alias("be"))
    totals = points.join(before, ["video_id", "tile"]).select(
        "video_id", "t", (F.coalesce(F.sum("s").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("bs")).alias("started"),
        (F.sum("e").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("be")).alias("ended"))
    at_end = totals.select("video_id", F.col("t").alias("end_time"), "started")
    at_start = totals.select("video_id", F.col("t").alias("start_time"), "ended")
    return clips.join(at_end, ["video_id", "end_time"]).join(at_start, ["video_id", "start_time"]).select(
        "video_id", "ord", (F.col("started") - F.col("ended") - 1).alias("overlaps"))


def snap_to_silence(clips: DataFrame, silences: DataFrame, search: float = 3.0, reach: float = 2.0,
                    shortest: float = 25.0) -> DataFrame:
    """Clip ends moved to the nearest silence, where one is close and the clip stays long enough.

    Needs clips (video_id, ord, start_time, end_time) and silences (video_id, t). Silences are gathered per tile, with those of both neighbours,
    and a clip meets the tile of its end, so that clips are read once, whatever they cost. Rows of one (video_id, ord) move to one silence.
    """
    width = max(8.0, search)
    tile = F.floor(F.col("t") / width)
    around = silences.select("video_id", "t", F.explode(F.array(tile - 1, tile, tile + 1)).alias("_tile")).groupBy("video_id", "_tile").agg(
        F.collect_set("t").alias("_quiet"))
    low, high = F.greatest(F.col("start_time"), F.col("end_time") - search), F.col("end_time") + search
    near = F.transform(F.filter("_quiet", lambda t: t.between(low, high)), lambda t: F.struct(F.abs(t - F.col("end_time")).alias("d"), t.alias("t")))
    met = clips.withColumn("_tile", F.floor(F.col("end_time") / width)).join(around, ["video_id", "_tile"], "left")
    best = met.withColumn("_near", F.array_min(near)).drop("_tile", "_quiet")
    known = F.col("video_id").isNotNull() & F.col("ord").isNotNull()
    joined = best.withColumn("quiet", F.when(known, F.min("_near").over(Window.partitionBy("video_id", "ord"))["t"])).drop("_near")
    good = (F.abs(F.col("quiet") - F.col("end_time")) <= reach) & (F.col("quiet") - F.col("start_time") >= shortest)
    return joined.withColumns({"end_time": F.when(good, tx.py_round(F.col("quiet"))).otherwise(F.col("end_time")),
                               "audio_refined": F.coalesce(good & (tx.py_round(F.col("quiet")) != F.col("end_time")), F.lit(False))}).drop("quiet")


def match_channel(videos: DataFrame, clips: DataFrame, threshold: float = 0.6, table_order: bool = False) -> DataFrame:
    """(id, clip_id, matched_by): the clip of each channel video, by platform id or by title similarity.

    An exact id wins; among similar titles the first clip in table order (``ord``) wins. With
    ``table_order`` an earlier similar title beats a later exact id.
    """
    by_id = videos.select("id").join(
        clips.select(F.col("youtube_video_id").alias("id"), "clip_id", "ord").where("id IS NOT NULL"), "id").select(
        "id", "clip_id", "ord", F.lit("id").alias("matched_by"))
    titles = clips.select("clip_id", "ord", F.explode(F.array("title", "shorts_title")).alias("title"))
    # Only the first clip of every distinct title set can win, so copies of a title cost one row.
    # Written: both are read for their words' counts, their signatures and the comparison.
    sets = cut_lineage(titles.withColumn("words", tx.lower_tokens(F.col("title"))).withColumn("class_id", sim.set_class(F.col("words"))).where(
        "class_id IS NOT NULL").groupBy("class_id").agg(
        F.any_value("words").alias("words"), F.min_by(F.struct("clip_id", "ord"), "ord").alias("first")))
    asked = videos.select("id", tx.lower_tokens(F.col("title")).alias("words")).withColumn("class_id", sim.set_class(F.col("words")))
    wanted = cut_lineage(sim.classes_of(asked, [], "words"))
    alike = sim.similar_classes(wanted, sets.select("class_id", "words"), threshold)
    first = alike.join(sets.select(F.col("class_id").alias("right_id"), "first"), "right_id").groupBy("left_id").agg(
        F.min_by("first", "first.ord").alias("first"))
    by_title = asked.join(first, F.col("class_id") == F.col("left_id")).select(
        "id", "first.clip_id", "first.ord", F.lit("title").alias("matched_by"))
    order = F.struct("ord", "matched_by") if table_order else F.struct("matched_by", "ord")
    return by_id.unionByName(by_title).groupBy("id").agg(F.min_by(F.struct("clip_id", "matched_by"), order).alias("m")).select("id", "m.*")


def published_with_snapshots(clips: DataFrame, snapshots: DataFrame, rows: int = 1000) -> DataFrame:
    """Published clips with their snapshots nested per day in time order, at most ``rows`` of them in a page.

    ``page`` counts a clip's pages of a day from 0, so that neither a clip nor a day with very many snapshots becomes one huge row.
    Clips without snapshots have one row of NULLs. Snapshots of one time are ordered by event_id.
    """
    live = clips.where("published").select("clip_id")
    day, minute, order = F.to_date("snapshot_time"), F.date_trunc("minute", "snapshot_time"), ["snapshot_time", "event_id"]
    own = snapshots.join(live, "clip_id", "left_semi").withColumn("day", day)
    # Hours, minutes and seconds of a day narrow the rows that one task has to order.
    levels = [F.date_trunc("hour", "snapshot_time"), minute, F.date_trunc("second", "snapshot_time")]
    placed = running_total(own, ["clip_id", "day"], levels, order, F.lit(1), "place")
    pages = placed.groupBy("clip_id", "day", F.floor((F.col("place") - 1) / rows).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("snapshot_time", "event_id", "views", "watch_time"))).alias("snapshots"))
    return clips.where("published").join(pages, "clip_id", "left")


def assign_tracks(clips: DataFrame, library: DataFrame) -> DataFrame:
    """The first track of the clip's category, else of ``default``, else of the root, else of any folder.

    Needs clips (clip_id, category) and library (path, category); root tracks have an empty category.
    """
    first = library.groupBy("category").agg(F.min("path").alias("path"))
    fallback = first.agg(F.min(F.when(F.col("category") == "default", F.col("path"))).alias("d"),
                         F.min(F.when(F.col("category") == "", F.col("path"))).alias("r"), F.min("path").alias("a"))
    any_track = fallback.select(F.coalesce("d", "r", "a")).scalar()
    return clips.join(first, "category", "left").withColumn("track", F.coalesce("path", any_track)).drop("path")


def track_license(tracks: DataFrame, companions: DataFrame) -> DataFrame:
    """License of each track from its companion file: ``name.json`` before ``name.mp3.json``."""
    files = companions.select(F.col("path").alias("file"), F.struct("license", "license_id").alias("meta"))
    base = F.concat(F.regexp_replace("path", r"\.[^./]*\z", ""), F.lit(".json"))
    named = tracks.withColumns({"_a": base, "_b": F.concat("path", F.lit(".json"))})
    out = named.join(files.select(F.col("file").alias("_a"), F.col("meta").alias("_m1")), "_a", "left").join(
        files.select(F.col("file").alias("_b"), F.col("meta").alias("_m2")), "_b", "left")
    meta = F.coalesce("_m1", "_m2")
    return out.withColumns({"license": F.coalesce(meta["license"], F.lit(lx.UNKNOWN_LICENSE)), "license_id": meta["license_id"]}).drop(
        "_a", "_b", "_m1", "_m2")


def unprocessed(videos: DataFrame, clips: DataFrame) -> DataFrame:
    """Videos that have no clips yet."""
    return videos.join(clips.select("video_id"), "video_id", "left_anti")

"""Order-dependent operators that never put a whole key into one task.

A window over a hot key would run in a single task. Here a key is cut into blocks of its ordering
(line tiles, minutes, days); the window runs per (key, block) and only one summary row per block is
ordered across the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_neighbours(df: DataFrame, keys: list[str], block: Column, order: list[str], payload: list[str],
                    previous: str | None = "prev", following: str | None = "next",
                    derive: Callable[[DataFrame], DataFrame] | None = None, kept: str | None = None) -> DataFrame:
    """Add the payload struct of the row before and after within the key (NULL at the ends).

    Both the rows and the first and last row of each block are read from ``df``. Where the payload is costly, ``derive`` adds it: once
    to each row and to the ends of the blocks, instead of twice to each row. Rows come out dealt by ``keys`` and block; ``kept`` names a
    column for the block, so that what follows can go on without dealing them again.
    """
    df = df.withColumn("_block", block)
    spec = Window.partitionBy(*keys, "_block").orderBy(*order)
    cells = F.struct(*payload)
    rank = F.struct(*order)
    raw = F.struct(*[c for c in df.columns if c not in (*keys, "_block")]) if derive else cells
    ends = df.groupBy(*keys, "_block").agg(F.min_by(raw, rank).alias("_first"), F.max_by(raw, rank).alias("_last"))
    if derive:
        for side, other in (("_first", "_last"), ("_last", "_first")):
            ends = derive(ends.select(*keys, "_block", other, f"{side}.*")).select(*keys, "_block", other, cells.alias(side))
        df = derive(df)
    across = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lag("_last").over(across).alias("_before"),
                       F.lead("_first").over(across).alias("_after"))
    out = df
    if previous:
        out = out.withColumn("_lag", F.lag(cells).over(spec))
    if following:
        out = out.withColumn("_lead", F.lead(cells).over(spec))
    out = out.join(ends, [*keys, "_block"], "left")
    if previous:
        out = out.withColumn(previous, F.coalesce("_lag", "_before"))
    if following:
        out = out.withColumn(following, F.coalesce("_lead", "_after"))
    out = out.withColumnRenamed("_block", kept) if kept else out.drop("_block")
    return out.drop("_lag", "_lead", "_before", "_after")


def running_total(df: DataFrame, keys: list[str], levels: list[Column], order: list[str], value: Column,
                  name: str) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``keys``.

    ``levels`` are coarse-to-fine prefixes of the order (day, second, ...): each narrows the rows of
    one task, and only the sums of a level are ordered inside the level above it.
    """
    marks = [f"_level{i}" for i in range(len(levels))]
    df = df.withColumns(dict(zip(marks, levels))).withColumn("_value", value)
    within = Window.partitionBy(*keys, *marks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, *marks).agg(F.sum("_value").alias("_sum"))
    offset = F.lit(0)
    for depth in range(len(marks), 0, -1):
        group, parent = [*keys, *marks[:depth]], [*keys, *marks[:depth - 1]]
        upto = Window.partitionBy(*parent).orderBy(marks[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = sums.groupBy(*group).agg(F.sum("_sum").alias("_s")) if depth < len(marks) else sums.withColumnRenamed("_sum", "_s")
        level = level.select(*group, F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias(f"_before{depth}"))
        sums_offsets = level if depth == len(marks) else sums_offsets.join(level, group)
        offset = offset + F.col(f"_before{depth}")
    offsets = sums_offsets.select(*keys, *marks, offset.alias("_offset"))
    return df.withColumn("_within", F.sum("_value").over(within)).join(offsets, [*keys, *marks]).withColumn(
        name, F.col("_within") + F.col("_offset")).drop(*marks, "_value", "_within", "_offset")


def filled_neighbours(cells: DataFrame, keys: list[str], at: str, fan: int = 1024, depth: int = 2) -> DataFrame:
    """(keys, at, before, after): ``last`` of the nearest earlier cell that has one and ``first`` of the nearest later one.

    ``cells(keys, at, first, last)``, one row per whole number ``at``; cells of NULLs are empty. Values are carried among ``fan`` neighbours,
    then among blocks of ``fan`` cells, and so on: a task orders the cells of one block, and across a key only one row per
    ``fan ** depth`` numbers is ordered.
    """
    block = F.floor(F.col(at) / fan)
    above = f"_above_{at}"
    group = [*keys, above] if depth else keys
    rows = cells.withColumn(above, block) if depth else cells
    earlier = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*group).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(*group, at, F.last("last", True).over(earlier).alias("before"), F.last("first", True).over(later).alias("after"))
    if not depth:
        return out
    blocks = rows.groupBy(*group).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    beyond = filled_neighbours(blocks, keys, above, fan, depth - 1).withColumnsRenamed({"before": "_before", "after": "_after"})
    return out.join(beyond, group).select(*keys, at, F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))


def spoken_durations(lines: DataFrame, block_lines: int = 4096, kept: str | None = None) -> DataFrame:
    """Seconds a line is spoken: up to the next line's start, its own length where that is under 0.5."""
    # line_idx is dense, so the next line of a block's last line is the first of the next block.
    out = with_neighbours(lines, ["video_id"], F.floor(F.col("line_idx") / block_lines), ["line_idx"],
                          ["line_idx", "start"], previous=None, kept=kept)
    end = F.col("start") + F.col("duration")
    span = F.least(end, F.coalesce(F.col("next.start"), end)) - F.col("start")
    return out.withColumn("spoken", F.when(span < 0.5, F.col("duration")).otherwise(span)).drop("next")


ENDED = ["completed", "failed"]


def status_changes(events: DataFrame, key: str = "job_id", ts: str = "ts", tie: str = "event_id",
                   watched: tuple[str, ...] = ("status", "progress"), ttl: int | None = None, carried: str | None = None) -> DataFrame:
    """Rows whose watched columns differ from the row before, up to the first terminal status.

    With ``ttl`` a job that was silent for more than so many seconds is forgotten: its next row starts a new life, is reported in any
    case, and may end again. ``carried`` names a boolean column of rows that are not reported themselves: the last rows of what was
    seen before, true if the life they belong to has ended, false if not, NULL for rows of this table. Rows are compared within minutes;
    only one row per minute is ordered across a job.
    """
    minute, order = F.date_trunc("minute", F.col(ts)), [ts, tie]
    seen = with_neighbours(events, [key], minute, order, [ts, *watched], following=None)
    changed = F.col("prev").isNull()
    for c in watched:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev.{c}"))
    over = F.col("status").isin(*ENDED)
    if carried:
        over = F.when(F.col(carried).isNull(), over).otherwise(F.col(carried))
    life = [key]
    if ttl is not None:
        instant = lambda c: F.unix_micros(c.cast("timestamp"))
        fresh = F.col("prev").isNull() | (instant(F.col(ts)) - instant(F.col(f"prev.{ts}")) > ttl * 1_000_000)
        seen = running_total(seen.withColumn("_fresh", F.coalesce(fresh, F.lit(False))), [key], [F.to_date(ts), minute], order, F.col("_fresh").cast("int"), "_life")
        changed, life = changed | F.col("_fresh"), [key, "_life"]
    ended = seen.where(over).groupBy(*life).agg(F.min(F.struct(*order)).alias("_end"))
    shown = changed & (F.col("_end").isNull() | (F.struct(*order) <= F.col("_end")))
    if carried:
        shown = shown & F.col(carried).isNull()
    return seen.join(ended, life, "left").where(shown).drop("prev", "_end", "_fresh", "_life")


def growth_curve(snapshots: DataFrame) -> DataFrame:
    """Position and 0..1 height of every snapshot in its clip's series, and the growth since the last one.

    Only clips with two or more snapshots have a curve.
    """
    day, minute = F.to_date("snapshot_time"), F.date_trunc("minute", "snapshot_time")
    order = ["snapshot_time", "event_id"]
    ranked = running_total(snapshots, ["clip_id"], [day, minute], order, F.lit(1), "rank")
    ranked = with_neighbours(ranked, ["clip_id"], minute, order, ["views"], following=None)
    limits = snapshots.groupBy("clip_id").agg(F.count("*").alias("n"), F.min("views").alias("low"),
                                              F.greatest(F.max("views"), F.lit(1)).alias("high")).where("n >= 2")
    span = F.when(F.col("high") == F.col("low"), 1).otherwise(F.col("high") - F.col("low"))
    return ranked.join(limits, "clip_id").select(
        "clip_id", "event_id", "views", F.col("rank").cast("bigint").alias("rank"),
        ((F.col("rank") - 1) / (F.col("n") - 1)).alias("x"), ((F.col("views") - F.col("low")) / span).alias("y"),
        (F.col("views") - F.col("prev.views")).alias("growth"))


def evict_plan(files: DataFrame, limit: int, target: int) -> DataFrame:
    """Files to delete, oldest first, once the total passes ``limit`` until it is at ``target``.

    Columns: path, mtime (seconds), size. ``.json`` files neither count nor go.
    """
    files = files.where(~F.endswith("path", F.lit(".json")))
    total = files.agg(F.sum("size").alias("t")).scalar()
    levels = [F.floor(F.col("mtime") / 86400), F.floor("mtime"), F.col("mtime"), F.substring(F.md5("path"), 1, 3)]
    ordered = running_total(files.withColumn("_hash", F.md5("path")), [], levels, ["mtime", "_hash", "path"], F.col("size"), "through")
    before = F.col("through") - F.col("size")
    return ordered.where((total > limit) & (total - before > target)).select("path", "mtime", "size", "through")


def longest_run(samples: DataFrame, flag: Column, block: int = 1024, key: str = "clip_id", frame: str = "frame") -> DataFrame:
    """Per clip the longest run of consecutive samples for which ``flag`` holds.

    Each block reports its length, the runs touching its two ends and the longest inside; a fold over
    these block rows joins runs across block borders.
    """
    rows = samples.withColumn("_on", flag.cast("int")).withColumn("_block", F.floor(F.col(frame) / block))
    spec = Window.partitionBy(key, "_block").orderBy(frame)
    marked = rows.withColumn("_island", F.row_number().over(spec) - F.sum("_on").over(spec))
    # Rows after the n-th gap of a block share an island; the gap row itself is its first row.
    islands = marked.groupBy(key, "_block", "_island").agg(F.sum("_on").alias("_run"))
    edges = islands.groupBy(key, "_block").agg(
        F.max("_run").alias("best"), F.min_by("_run", "_island").alias("head"), F.max_by("_run", "_island").alias("tail"),
        F.min("_island").alias("low"), F.max("_island").alias("high"))
    solid = (F.col("low") == 0) & (F.col("high") == 0)
    head = F.when(F.col("low") == 0, F.col("head")).otherwise(0)
    blocks = edges.select(key, "_block", "best", head.alias("head"), F.col("tail"), solid.alias("solid"))
    across = Window.partitionBy(key).orderBy("_block")
    # A border run is a tail, the solid blocks after it and the head of the block that ends it.
    broken = blocks.withColumn("_part", F.coalesce(F.sum((~F.col("solid")).cast("int")).over(
        across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = broken.groupBy(key, "_part").agg(
        F.max("best").alias("best"), F.sum(F.when(F.col("solid"), F.col("tail")).otherwise(F.col("head"))).alias("mid"),
        F.max(F.when(~F.col("solid"), F.col("tail"))).alias("out"))
    carry = Window.partitionBy(key).orderBy("_part")
    return joined.withColumn("_border", F.col("mid") + F.coalesce(F.lag("out").over(carry), F.lit(0))).groupBy(key).agg(
        F.greatest(F.max("best"), F.max("_border")).cast("bigint").alias("longest_run"))

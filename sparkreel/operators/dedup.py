"""Greedy deduplication of clips: keep a clip unless it conflicts with a kept one of higher priority.

The clips of a video are cut along time into blocks, and every block is folded once in the order of priority into kept, dropped and
unknown clips: unknown is what may depend on a clip of another block, or conflicts with an unknown one. What conflicts with a kept clip
goes, and the rest is cut anew, with borders in other places, until nothing is unknown. A video of one block has no borders and is
settled at once; a hot one is spread over its blocks. No list of a whole video and no table of its conflicting pairs is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.functions import text as tx
from sparkreel.operators import ordered
from sparkreel.session import cut_lineage

BLOCK = 1024
TIME_TILE = 64.0
LINE_TILE = 8


def _fold(nodes: DataFrame, fields: list[str], conflict) -> DataFrame:
    """(video_id, ord, keep) of the decided clips; ``nodes`` has _block, and _inner: no clip of another block comes into question before it."""
    cell = F.struct(*fields)
    rows = nodes.groupBy("video_id", "_block").agg(F.sort_array(F.collect_list(F.struct("rank", cell.alias("c"), "_inner"))).alias("all"))
    cells = F.filter(F.transform("all", lambda x: x["c"]), lambda x: F.lit(False))
    states = F.array().cast("array<struct<ord: int, keep: boolean>>")

    def step(acc: Column, x: Column) -> Column:
        among = lambda name: F.exists(acc[name], lambda k: conflict(k, x["c"]))
        add = lambda kept, unknown, out: F.struct(kept.alias("kept"), unknown.alias("unknown"), out.alias("out"))
        said = lambda keep: F.array_append(acc["out"], F.struct(x["c"]["ord"].cast("int").alias("ord"), F.lit(keep).alias("keep")))
        return F.when(among("kept"), add(acc["kept"], acc["unknown"], said(False))).when(
            x["_inner"] & ~among("unknown"), add(F.array_append(acc["kept"], x["c"]), acc["unknown"], said(True))).otherwise(
            add(acc["kept"], F.array_append(acc["unknown"], x["c"]), acc["out"]))

    start = F.struct(cells.alias("kept"), cells.alias("unknown"), states.alias("out"))
    folded = rows.select("video_id", F.aggregate("all", start, step)["out"].alias("out"))
    return folded.select("video_id", F.explode("out").alias("o")).select("video_id", "o.ord", "o.keep")


def _in_blocks(undecided: DataFrame, block: int, turn: int) -> DataFrame:
    """Blocks of ``block`` clips along time, moved by half a block every other turn, and which clips wait for none of another block.

    Conflicting clips share a group. A clip may wait for another block if the best clip of one of its groups, outside its own
    block, comes before it; two rows per group, the best and the best of other blocks, tell that.
    """
    levels = [F.floor(F.col("s") / 64), F.col("s"), F.floor(F.col("ord") / 1024)]
    placed = ordered.running_total(undecided, ["video_id"], levels, ["s", "ord"], F.lit(1), "_place")
    placed = placed.withColumn("_block", F.floor((F.col("_place") - 1 + turn % 2 * (block // 2)) / block)).drop("_place")
    entries = placed.select("video_id", "ord", "rank", "_block", F.explode("groups").alias("group"))
    best = entries.groupBy("video_id", "group", "_block").agg(F.min("rank").alias("r"))
    first = best.groupBy("video_id", "group").agg(F.min(F.struct("r", "_block")).alias("f"))
    others = best.join(first, ["video_id", "group"]).where(F.col("_block") != F.col("f._block")).groupBy("video_id", "group").agg(
        F.first("f").alias("f"), F.min("r").alias("second"))
    # A group within one block holds nobody back.
    waits = entries.join(others, ["video_id", "group"]).where(
        F.when(F.col("_block") == F.col("f._block"), F.col("second")).otherwise(F.col("f.r")) < F.col("rank"))
    outer = waits.select("video_id", "ord").distinct().withColumn("_inner", F.lit(False))
    return placed.join(outer, ["video_id", "ord"], "left").withColumn("_inner", F.coalesce("_inner", F.lit(True)))


def _beaten(rest: DataFrame, kept: DataFrame, fields: list[str], conflict) -> DataFrame:
    """(video_id, ord) of ``rest`` in conflict with a clip of ``kept``; both have their groups and ``fields``."""
    id_ = ["video_id", "ord"]
    entries = lambda df, name: df.select("video_id", F.col("ord").alias(name), F.explode("groups").alias("group"))
    met = entries(rest, "ord").join(entries(kept, "by"), ["video_id", "group"]).select(*id_, "by").distinct()
    cell = F.struct(*fields)
    both = met.join(kept.select("video_id", F.col("ord").alias("by"), cell.alias("k")), ["video_id", "by"]).join(rest.select(*id_, cell.alias("x")), id_)
    return both.where(conflict(F.col("k"), F.col("x"))).select(*id_).distinct()


def _greedy(nodes: DataFrame, fields: list[str], conflict, with_groups, block: int) -> DataFrame:
    """(video_id, ord) of the kept clips; ``with_groups`` adds ``groups`` such that every two conflicting clips share one."""
    id_ = ["video_id", "ord"]
    sizes = nodes.groupBy("video_id").count().where(F.col("count") > block).select("video_id")
    whole = nodes.join(sizes, "video_id", "left_anti").withColumns({"_block": F.lit(0), "_inner": F.lit(True)})
    kept = _fold(whole, fields, conflict).where("keep").select(*id_)
    if sizes.isEmpty():
        return kept
    undecided, turn = cut_lineage(with_groups(nodes.join(sizes, "video_id", "left_semi"))), 0
    while not undecided.isEmpty():
        verdict = cut_lineage(_fold(_in_blocks(undecided, block, turn), fields, conflict))
        chosen = verdict.where("keep").select(*id_)
        kept, turn = kept.unionByName(chosen), turn + 1
        rest = undecided.join(verdict.select(*id_), id_, "left_anti")
        undecided = cut_lineage(rest.join(_beaten(rest, undecided.join(chosen, id_, "left_semi"), fields, conflict), id_, "left_anti"))
    return kept


def _tiles(prefix: str, low: Column, high: Column, width: float) -> Column:
    """Numbers of the tiles that the half-open interval touches; that two tiles may share one costs comparisons and changes no result."""
    first = F.floor(low / width)
    last = F.greatest(first, F.ceil(high / width) - 1)
    return F.transform(F.sequence(first, last), lambda t: F.xxhash64(F.lit(prefix), t))


def dedup_candidates(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidates kept by score (ties: list order) such that no two share a transcript line.

    Needs video_id, ord, start_index, end_index (inclusive), virality_score.
    """
    score = F.coalesce("virality_score", F.lit(0.0))
    nodes = candidates.select("video_id", "ord", F.struct((-score).alias("p"), F.col("ord").alias("o")).alias("rank"),
                              F.col("start_index").alias("s"), F.col("end_index").alias("e"))
    conflict = lambda k, x: (k["s"] <= x["e"]) & (k["e"] >= x["s"])
    tiles = lambda df: df.withColumn("groups", _tiles("t", F.col("s"), F.col("e") + 1, LINE_TILE))
    kept = _greedy(cut_lineage(nodes), ["ord", "s", "e"], conflict, tiles, block)
    return candidates.join(kept, ["video_id", "ord"], "left_semi")


TEXT_LIMIT, HOOK_LIMIT, LINE_LIMIT = 0.8, 0.75, 0.6


def clip_nodes(clips: DataFrame) -> DataFrame:
    """What clips are compared by; ``dedup_clips`` and ``drop_reasons`` take it, staged, where both are asked for."""
    span = F.col("end_time") - F.col("start_time")
    priority = F.when(F.col("virality_score") > 0, F.col("virality_score")).otherwise(span)
    hooks = tx.word_set(F.concat_ws(" ", F.coalesce("shorts_title", F.lit("")), F.coalesce("title", F.lit(""))))
    return clips.select("video_id", "ord", F.struct((-priority).alias("p"), F.col("ord").alias("o")).alias("rank"),
                        F.col("start_time").alias("s"), F.col("end_time").alias("e"), F.col("start_index").alias("ls"),
                        F.col("end_index").alias("le"), tx.word_set(F.col("text")).alias("words"), hooks.alias("hooks"))


def _interval_conflict(k: Column, x: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(k["le"], x["le"]) - F.greatest(k["ls"], x["ls"]) + 1)
    total = (k["le"] - k["ls"] + 1) + (x["le"] - x["ls"] + 1) - shared
    return ((k["s"] < x["e"]) & (k["e"] > x["s"])) | (shared > LINE_LIMIT * total)


def _clip_conflict(k: Column, x: Column) -> Column:
    return (_interval_conflict(k, x) | (tx.jaccard(k["words"], x["words"]) > TEXT_LIMIT)
            | (tx.jaccard(k["hooks"], x["hooks"]) > HOOK_LIMIT))


def _rare_words(nodes: DataFrame, words: str, threshold: float, prefix: str) -> DataFrame:
    """(video_id, ord, names): of each set its rarest words in the video, so many that sets above ``threshold`` share one. Words go by number."""
    number = F.transform(words, lambda w: F.xxhash64(F.lit(prefix), w))
    tokens = nodes.select("video_id", "ord", F.size(words).alias("n"), F.explode(number).alias("word"))
    counts = tokens.groupBy("video_id", "word").agg(F.count("*").alias("df"))
    ranked = tokens.join(counts, ["video_id", "word"]).groupBy("video_id", "ord", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("all"))
    # The small slack keeps a product such as 0.6 * 5 from rounding up past its integer.
    share = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    return ranked.select("video_id", "ord", F.slice("all", F.lit(1), share)["word"].alias(f"{words}_groups"))


def _with_groups(nodes: DataFrame) -> DataFrame:
    out = nodes
    for words, threshold, prefix in (("words", TEXT_LIMIT, "w"), ("hooks", HOOK_LIMIT, "h")):
        out = out.join(_rare_words(nodes, words, threshold, prefix), ["video_id", "ord"], "left")
    none = F.array().cast("array<bigint>")
    named = F.concat(_tiles("t", F.col("s"), F.col("e"), TIME_TILE), _tiles("l", F.col("ls"), F.col("le") + 1, LINE_TILE),
                     F.coalesce("words_groups", none), F.coalesce("hooks_groups", none))
    return out.withColumn("groups", named).drop("words_groups", "hooks_groups")


FIELDS = ["ord", "s", "e", "ls", "le", "words", "hooks"]


def dedup_clips(clips: DataFrame, block: int = BLOCK, nodes: DataFrame | None = None) -> DataFrame:
    """Clips kept by score (by length where there is none) that differ in time, lines, text and hook.

    Needs video_id, ord, start_time, end_time, start_index, end_index, virality_score, title,
    shorts_title and the clip's whole text. The input is used several times, so it is staged once. With ``nodes``, staged rows of
    ``clip_nodes``, the clips' ids will do.
    """
    if nodes is None:
        clips = cut_lineage(clips)
        nodes = cut_lineage(clip_nodes(clips))
    kept = _greedy(nodes, FIELDS, _clip_conflict, _with_groups, block)
    return clips.join(kept, ["video_id", "ord"], "left_semi")


def drop_reasons(clips: DataFrame, kept: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Why each dropped clip went: the highest-priority kept clip it conflicts with and the first check that failed.

    ``nodes`` are staged rows of ``clip_nodes`` of the same clips, whose ids will do then.
    """
    id_ = ["video_id", "ord"]
    # Word sets are read five times to name the groups, so they are staged before; the names are staged without them.
    nodes = cut_lineage(clip_nodes(clips)) if nodes is None else nodes
    kept = cut_lineage(kept.select(*id_))
    names = cut_lineage(_with_groups(nodes).select(*id_, "groups")).select(*id_, F.explode("groups").alias("group"))
    held = names.join(kept, id_, "left_semi").withColumnRenamed("ord", "by")
    met = names.join(kept, id_, "left_anti").join(held, ["video_id", "group"]).select(*id_, "by").distinct()
    cell = F.struct("rank", *FIELDS)
    cells = nodes.select(*id_, cell.alias("cell"))
    # Only kept clips are met, and only by dropped ones.
    by = cells.join(kept, id_, "left_semi").select("video_id", F.col("ord").alias("by"), F.col("cell").alias("k"))
    both = met.join(by, ["video_id", "by"]).join(cells.join(kept, id_, "left_anti").withColumnRenamed("cell", "x"), id_)
    k, x = F.col("k"), F.col("x")
    hit = (F.when((k["s"] < x["e"]) & (k["e"] > x["s"]), "temporal overlap").when(_interval_conflict(k, x), "index redundancy")
           .when(tx.jaccard(k["words"], x["words"]) > TEXT_LIMIT, "text-level semantic redundancy")
           .when(tx.jaccard(k["hooks"], x["hooks"]) > HOOK_LIMIT, "hook concept redundancy"))
    found = both.where(k["rank"] < x["rank"]).withColumn("reason", hit).where("reason IS NOT NULL")
    return found.groupBy(*id_).agg(F.min_by(F.struct("reason", F.col("by").alias("kept_ord")), F.col("k.rank")).alias("r")).select(*id_, "r.*")

"""A uniform shuffle of transcripts into training shards of exact size."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window, functions as F


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without return from ``good`` + ``bad`` are good.

    Small cases walk the inverse distribution; large ones use ratio-of-uniforms rejection, whose cost doesn't grow with the counts.
    """
    total = good + bad
    if draws * 2 > total:
        return good - hypergeometric(rng, good, bad, total - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    if draws == 0 or good == 0:
        return 0
    log_weight = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))
    least, most = max(0, draws - bad), min(draws, good)
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))
    top = log_weight(mode)
    if most - least < 32:
        weights = [math.exp(log_weight(k) - top) for k in range(least, most + 1)]
        return rng.choices(range(least, most + 1), weights)[0]
    mean = draws * good / total
    spread = math.sqrt((total - draws) * mean * (bad / total) / (total - 1) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if least <= k <= most and 2 * math.log(u) <= log_weight(k) - top:
            return k


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> list[list[int]]:
    """How many rows each source sends to each target, drawn as a uniform shuffle would: rows sum to ``sources``, columns to ``targets``."""
    rng, left, matrix = random.Random(seed), list(targets), []
    for size in sources:
        row, rest, open_slots = [], size, sum(left)
        for slots in left:
            open_slots -= slots
            taken = hypergeometric(rng, slots, open_slots, rest)
            row.append(taken)
            rest -= taken
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _constant(rows: list[list[int]]) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")


def shuffle_into_shards(transcripts: DataFrame, shards: int = 16, seed: int = 20, blocks: int = 1024, parts: int = 64) -> DataFrame:
    """Deal transcripts into ``shards`` whose row counts differ by one at most, in uniformly random order.

    ``transcripts(video_id, transcript, ...)``. Returns all its columns and ``shard int``, ``slot bigint`` (gapless from 0 in each
    shard); existing columns of these names are replaced.

    Rows fall into ``blocks`` of almost equal size by a hash of their place in the table. From the blocks' sizes the matrix of
    rows per block and shard is drawn (multivariate hypergeometric); each block is permuted and its first rows go to shard 0, the
    next to shard 1 and so on; each shard is permuted again, cut into ``parts`` so that no task holds a whole shard. What reaches
    the driver are blocks + shards * parts counts, whatever the input's size; no row does.

    No column decides where a row goes: NULLs, repeated rows and hot keys are dealt like any others. The place of a row is taken
    from the scan, so the input should be a table as read or checkpointed, which gives the same places when a task runs again.
    An empty table gives no rows.
    """
    spark = transcripts.sparkSession
    place = F.monotonically_increasing_id()
    keep = [c for c in transcripts.columns if c not in ("shard", "slot")]
    rows = transcripts.select(*keep, place.alias("_place")).withColumn(
        "_block", F.pmod(F.xxhash64("_place", F.lit(seed)), F.lit(blocks)).cast("int"))
    counts = dict(rows.groupBy("_block").count().collect())
    sizes = [counts.get(k, 0) for k in range(blocks)]
    total = sum(sizes)
    targets = [total // shards + (k < total % shards) for k in range(shards)]
    ends = []
    for row in communication_matrix(sizes, targets, seed):
        ends.append([sum(row[:k + 1]) for k in range(shards)])

    first = Window.partitionBy("_block").orderBy(F.xxhash64("_place", F.lit(seed + 1)), "_place")
    bounds = F.element_at(_constant(ends), F.col("_block") + 1)
    dealt = rows.withColumn("_rank", F.row_number().over(first)).withColumn(
        "shard", F.size(F.filter(bounds, lambda end: end < F.col("_rank"))).cast("int"))
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("_place", F.lit(seed + 2)), F.lit(parts)).cast("int"))

    filled = {(r["shard"], r["_part"]): r["count"] for r in dealt.groupBy("shard", "_part").count().collect()}
    starts = []
    for shard in range(shards):
        own = [filled.get((shard, part), 0) for part in range(parts)]
        starts.append([sum(own[:part]) for part in range(parts)])
    second = Window.partitionBy("shard", "_part").orderBy(F.xxhash64("_place", F.lit(seed + 3)), "_place")
    start = F.element_at(F.element_at(_constant(starts), F.col("shard") + 1), F.col("_part") + 1)
    return dealt.withColumn("slot", (F.row_number().over(second) - 1 + start).cast("bigint")).select(*keep, "shard", "slot")

"""A Merkle manifest of transcript records: leaves in order, digest-to-children records, proofs by descent from the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from sparkreel.session import cut_lineage

#: Rank digits a block of records covers: it holds up to 2 ** BITS nodes and all records above them.
BITS = 8
BLOCK = 1 << BITS
STEP = "array<struct<left: string, right: string>>"
RECORDS = pa.map_(pa.string(), pa.list_(pa.string()))


def record_digest(*fields: Column) -> Column:
    """SHA-256 in hex of the fields in order: ``-`` for NULL, else the UTF-8 length, a colon and the value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def _digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_part`` and ``_at``: their range partition along ``order`` and the place there. NULL comes first.

    Rows that are equal in ``order`` are spread by a number of their own, so no partition is larger for them.
    """
    rows = cut_lineage(rows).withColumn("_tie", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    inside = F.lit((1 << 33) - 1)
    return cut_lineage(spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(inside)}))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``tree_no``, ``rank`` and ``size``, the trees: ``tree``, ``tree_no``, ``size``); trees are numbered in their order.

    Only counts per range partition and tree are ordered across partitions, so a tree of any size is spread over tasks.
    """
    rows = numbered(rows, [tree, *order])
    ends = rows.groupBy("_part", tree).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = cut_lineage(ends.withColumn("_before", F.coalesce(before, F.lit(0))))
    trees = numbered(ends.groupBy(tree).agg(F.sum("_n").alias("size")), [tree])
    parts = trees.groupBy("_part").count().withColumn(  # a row for each partition
        "_offset", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trees = cut_lineage(trees.join(parts, "_part").select(tree, "size", (F.col("_offset") + F.col("_at")).alias("tree_no")))
    facts = ends.join(trees.withColumnRenamed(tree, "_tree"), F.col(tree).eqNullSafe(F.col("_tree"))).select(
        F.col("_part").alias("_p"), "_tree", "_low", "_before", "size", "tree_no")
    placed = rows.join(facts, (rows["_part"] == facts["_p"]) & rows[tree].eqNullSafe(facts["_tree"]))
    rank = F.col("_at") - F.col("_low") + F.col("_before")
    return placed.withColumn("rank", rank).drop("_part", "_at", "_p", "_tree", "_low", "_before"), trees


def _levels(nodes: int) -> int:
    """Levels above so many nodes, within one block."""
    return min(BITS, (nodes - 1).bit_length())


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of each run of equal keys; a run is a block, so it is short."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield held
                held = []
            held.append(row)
            last = key
    if held:
        yield held


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of nodes to their top node and the records between."""
    for block in _groups(batches, ("tree_no", "block")):
        nodes, records = [row["digest"] for row in block], {}
        levels = _levels(block[0]["size"])
        for _ in range(levels):
            runs = [nodes[i:i + 2] for i in range(0, len(nodes), 2)]
            nodes = [_digest(run) for run in runs]
            records.update(zip(nodes, runs))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block[0]["tree_no"]]), pa.array([block[0]["block"]]), pa.array(nodes), pa.array([-(-block[0]["size"] >> levels)]),
             pa.array([levels], pa.int32()), pa.array([list(records.items())], RECORDS)], ["tree_no", "number", "digest", "size", "levels", "children"])


@dataclass
class Forest:
    """Trees over numbered leaves: their tops (tree_no, digest) and, pass by pass from the leaves, the records of their blocks."""
    tops: DataFrame
    passes: list[DataFrame]


def build(leaves: DataFrame) -> Forest:
    """Fold ``leaves(tree_no, rank, size, digest)`` to one node a tree, BITS levels at a time; every pass is written to the shared folder."""
    nodes = leaves.select("tree_no", F.col("rank").alias("number"), "digest", "size")
    passes = []
    while True:
        blocks = nodes.withColumn("block", F.shiftright("number", BITS)).repartition("tree_no", "block").sortWithinPartitions("tree_no", "block", "number")
        done = cut_lineage(blocks.mapInArrow(
            _folded, "tree_no bigint, number bigint, digest string, size bigint, levels int, children map<string, array<string>>"))
        passes.append(done.select("digest", "levels", "children"))
        nodes = done.select("tree_no", "number", "digest", "size")
        if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
            return Forest(nodes.select("tree_no", "digest"), passes)


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the top of each block down to the nodes asked for; the children passed by are collected as steps."""
    for batch in batches:
        asked_for = batch.column("asked")
        for i, row in enumerate(batch.drop_columns(["asked"]).to_pylist()):
            children, above = dict(row["children"]), [(s["left"], s["right"]) for s in row["steps"]]
            asked = asked_for[i].values
            digits = asked.field("digit").to_pylist()
            ends, lefts, rights, sizes = [], [], [], [0]
            for digit in digits:
                at, steps = row["digest"], list(above)
                for level in reversed(range(row["levels"])):
                    both, bit = children[at], digit >> level & 1
                    steps.append(("".join(both[:bit]), "".join(both[bit + 1:])))
                    at = both[bit]
                ends.append(at)
                lefts += [s[0] for s in steps]
                rights += [s[1] for s in steps]
                sizes.append(len(lefts))
            steps = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"]))
            n = len(digits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree_no"]] * n, pa.int64()), pa.array([row["number"] * BLOCK + d for d in digits], pa.int64()), pa.array(ends, pa.string()),
                 pa.array([row["top"]] * n, pa.string()), steps, asked.field("payload")], ["tree_no", "number", "digest", "top", "steps", "payload"])


def descend(forest: Forest, tops: DataFrame, requests: DataFrame) -> DataFrame:
    """Leaf requests from the tops of their trees down to the leaves.

    ``tops(tree_no, digest, steps)`` are the starts, ``requests(tree_no, rank, payload)`` name each leaf at most once. Requests with the
    same leading digits go down as one, so a pass looks up each block once and no node, not even the root, is a hot key. Returns
    ``(tree_no, number, digest, top, steps, payload)``: the leaf, its tree's top and, from the top down, what stood left and right of the way.
    """
    last = len(forest.passes) - 1
    block = F.shiftright("number", BITS)
    digit = F.col("number").bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    wanted = [requests.select("tree_no", F.col("rank").alias("number"), "payload")]
    for _ in range(last):
        wanted.append(wanted[-1].select("tree_no", block.alias("number")).distinct().withColumn("payload", F.lit(None).cast("boolean")))
    state = tops.select("tree_no", F.lit(0).cast("bigint").alias("number"), "digest", F.col("digest").alias("top"), "steps")
    for level in range(last, -1, -1):
        kind = StructType([*state.select("tree_no", "number", "digest", "top", "steps").schema, wanted[level].schema["payload"]])
        asked = wanted[level].groupBy("tree_no", block.alias("number")).agg(F.collect_list(F.struct(digit.alias("digit"), "payload")).alias("asked"))
        # Blocks of equal content have one digest and one record.
        store = forest.passes[level].groupBy("digest").agg(*[F.first(c).alias(c) for c in ("levels", "children")])
        rows = state.join(asked, ["tree_no", "number"]).join(store, "digest")
        state = rows.mapInArrow(_descended, kind)
        if level:
            state = cut_lineage(state.drop("payload"))
    return state


@dataclass
class Manifest:
    """The root, the forest over all leaves, the tree over the shards' subroots, and where each record stands."""
    root: str | None
    shards: Forest
    top: Forest
    subroots: DataFrame
    placed: DataFrame


def build_manifest(leaves: DataFrame, shard: str = "language", key: str = "video_id") -> Manifest:
    """The Merkle manifest of transcript records.

    ``leaves`` has ``key``, ``shard``, ``leaf`` (see ``record_digest``) and any columns that are to come back with the proofs. Per shard
    (NULL is one, the first) leaves ascend by key (NULL first, equal keys by leaf); pairs of neighbours become their digest, an odd last one
    the digest of itself alone, until one is left: the subroot, a lone leaf itself. Subroots in the order of their shards give the
    root in the same way; no rows give none. Records and passes are written to the shared folder.
    """
    rows, trees = ranked(leaves, shard, [key, "leaf"])
    rows = cut_lineage(rows)
    forest = build(rows.select("tree_no", "rank", "size", F.col("leaf").alias("digest")))
    subroots = cut_lineage(trees.join(forest.tops, "tree_no"))
    total = subroots.count()
    top = build(subroots.select(F.lit(0).cast("bigint").alias("tree_no"), F.col("tree_no").alias("rank"), F.lit(total).cast("bigint").alias("size"), "digest"))
    first = top.tops.first()
    return Manifest(first.digest if first else None, forest, top, subroots, rows)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Inclusion proofs of ``requests``: rows of ``manifest.placed``, or some of them, each at most once.

    Adds to them ``subroot``, ``root`` and ``proof``: from the leaf up, what stands left and right of the way at each level (empty: nothing).
    """
    none = F.array().cast(STEP)
    starts = manifest.top.tops.select("tree_no", "digest", none.alias("steps"))
    shards = requests.select("tree_no").distinct()
    down = descend(manifest.top, starts, shards.select(F.lit(0).cast("bigint").alias("tree_no"), F.col("tree_no").alias("rank"), F.lit(True).alias("payload")))
    tops = cut_lineage(down.select(F.col("number").alias("tree_no"), "digest", "steps"))
    payload = F.struct(*[c for c in requests.columns if c not in ("tree_no", "rank")])
    found = descend(manifest.shards, tops, requests.select("tree_no", "rank", payload.alias("payload")))
    return found.select("payload.*", F.col("top").alias("subroot"), F.lit(manifest.root).alias("root"), F.reverse("steps").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]).cast("binary"), 256))

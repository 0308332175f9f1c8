"""Fixity audit of archive replicas: Merkle trees over records and offset ranges, compared from the root down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.session import cut_lineage

BRANCHES = 16


def _joined(children: Column) -> Column:
    """One digest of ordered ``struct(place, digest)`` children."""
    text = F.transform(F.array_sort(children), lambda x: F.concat_ws(":", x["place"].cast("string"), x["digest"]))
    return F.sha2(F.array_join(text, "\n").cast("binary"), 256)


def leaves(records: DataFrame) -> DataFrame:
    """``records(archive, record_offset, payload)`` to ``(archive, record_offset, digest)``, where payload is text or binary."""
    digest = F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")), 256)
    return records.select(F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"),
                          F.coalesce(F.col("record_offset").cast("bigint"), F.lit(-1).cast("bigint")).alias("record_offset"), digest.alias("digest"))


def tree(leaf_rows: DataFrame, span: int, height: int, prefix: int) -> list[DataFrame]:
    """Levels from the offset ranges up to the root, each ``(node, parent, digest)``.

    A range covers ``span`` bytes of an archive; ``height`` levels of 16 branches lead to the archive, then ``prefix`` hexadecimal digits of the
    archive's hash, one a level, to the root. A level is made from the one below, never from the records again.
    """
    name = F.sha2(F.col("archive").cast("binary"), 256)
    low = leaf_rows.groupBy("archive", F.floor(F.col("record_offset") / span).alias("place")).agg(
        _joined(F.collect_list(F.struct(F.col("record_offset").alias("place"), "digest"))).alias("digest"))
    label = lambda place: F.concat_ws("/", name, place.cast("string"))
    up = F.floor(F.col("place") / BRANCHES)
    levels, now = [], low
    for _ in range(height):
        levels.append(now.select(label(F.col("place")).alias("node"), label(up).alias("parent"), "digest"))
        now = now.groupBy("archive", up.alias("up")).agg(_joined(F.collect_list(F.struct("place", "digest"))).alias("digest")).withColumnRenamed("up", "place")
    now = now.select(label(F.col("place")).alias("node"), name.alias("place"), "digest")
    for digits in range(prefix, -1, -1):
        parent = F.substring("place", 1, digits)
        levels.append(now.select("node", parent.alias("parent"), "digest"))
        now = now.groupBy(parent.alias("up")).agg(_joined(F.collect_list(F.struct("place", "digest"))).alias("digest")).select(
            F.col("up").alias("node"), F.col("up").alias("place"), "digest")
    levels.append(now.select("node", F.lit(None).cast("string").alias("parent"), "digest"))
    return levels


def audit_replicas(left: DataFrame, right: DataFrame, span: int = 16 << 20, prefix: int = 3) -> DataFrame:
    """Records in which two replicas of an archive differ.

    Both are ``(archive, record_offset, payload)``. Returns ``(archive, record_offset, status, left_digest, right_digest)`` for records that
    are ``changed``, ``missing_left`` or ``missing_right``. The project keeps no archive of its own, so the operator is general: stage tables
    or transcript files fit as well as web archives.

    Each replica is hashed once, into record digests kept in the shared folder; on these stands a Merkle tree of offset ranges, archives
    and name prefixes. The replicas' roots are compared, and of every level only the children of differing nodes, so equal branches are
    left after one comparison and records are compared only in differing ranges. Nodes gather their children, a range's records or 16
    nodes, never an archive.

    A NULL payload is an empty one, a NULL archive the empty name, a NULL offset -1. Records repeated at an offset are compared as
    ordered lists: digests are joined by commas. Empty replicas differ in all that the other has.
    """
    both = [cut_lineage(leaves(side)) for side in (left, right)]
    last = reduce(lambda a, b: max(a, b), [(rows.agg(F.max("record_offset")).first()[0] or 0) // span for rows in both], 0)
    height = 1
    while BRANCHES ** height <= last:
        height += 1
    trees = [[cut_lineage(level) for level in tree(rows, span, height, prefix)] for rows in both]

    differing = None
    for a, b in zip(*[reversed(levels) for levels in trees], strict=True):
        if differing is not None:
            below = differing.select(F.col("node").alias("parent"))
            a, b = (side.join(below, "parent", "left_semi") for side in (a, b))
        met = a.select("node", F.col("digest").alias("x")).join(b.select("node", F.col("digest").alias("y")), "node", "full")
        differing = cut_lineage(met.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node"))

    place = F.concat_ws("/", F.sha2(F.col("archive").cast("binary"), 256), F.floor(F.col("record_offset") / span).cast("string"))
    sides = []
    for rows, name in zip(both, ("left_digest", "right_digest"), strict=True):
        inside = rows.withColumn("node", place).join(differing, "node", "left_semi")
        sides.append(inside.groupBy("archive", "record_offset").agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias(name)))
    met = sides[0].join(sides[1], ["archive", "record_offset"], "full").filter(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
    status = F.when(F.col("left_digest").isNull(), "missing_left").when(F.col("right_digest").isNull(), "missing_right").otherwise("changed")
    return met.select("archive", "record_offset", status.alias("status"), "left_digest", "right_digest")

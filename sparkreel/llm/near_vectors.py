"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, links confirmed by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkreel.lexicon import FACTORS
from sparkreel.llm.graph import components
from sparkreel.session import cut_lineage

BLOCK = 256


def factor_vectors(clips: DataFrame) -> DataFrame:
    """``clips(clip_id, detailed_scores, experiment_id)`` as input of ``near_vectors``: the scoring factors in order are the vector."""
    return clips.select("clip_id", F.array(*[F.col("detailed_scores")[name] for name in FACTORS]).alias("vector"), F.col("experiment_id").alias("label"))


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two long) after a sign flip and a Hadamard transform for each row of ``signs``."""
    for flip in signs:
        x = x * flip
        half = 1
        while half < x.shape[1]:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
            half *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def probed(vectors: np.ndarray, tables: int, polytopes: int, probes: int, seed: int) -> np.ndarray:
    """Codes of unit vectors: (row, table, 1 + probes). The first is the row's own bucket, the others the nearest to it.

    In each of ``polytopes`` rotations the own vertex is the signed axis of the largest coordinate. A probe replaces one of
    them by that rotation's second or third vertex, in order of the least loss.
    """
    n, dim = vectors.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    rng = np.random.default_rng(seed)
    codes = np.zeros((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for table in range(tables):
        best, options = np.zeros(n, np.int64), []
        for k in range(polytopes):
            y = rotated(padded, rng.choice([-1.0, 1.0], (3, size)))
            place = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            value = np.take_along_axis(y, place, axis=1)
            vertex = 2 * place + (value < 0)
            scale = (2 * size) ** k
            best += vertex[:, 0] * scale
            for other in range(1, min(3, size)):
                options.append((np.abs(value[:, 0]) - np.abs(value[:, other]), (vertex[:, other] - vertex[:, 0]) * scale))
        codes[:, table, 0] = best
        loss, step = np.stack([o[0] for o in options], axis=1), np.stack([o[1] for o in options], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        for p in range(probes):
            codes[:, table, 1 + p] = best + step[rows, order[:, p % order.shape[1]]]
    return codes


def unit(values: pa.Array, size: int) -> np.ndarray:
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(tables: int, polytopes: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector")], np.int64)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                codes = probed(unit(part.column("vector"), int(size)), tables, polytopes, probes, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * tables * (1 + probes), pa.int32()), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "codes"])
    return run


def _local_roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``ids`` reaches by the links between positions ``i`` and ``j``."""
    roots = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    while True:
        before = roots.copy()
        np.minimum.at(roots, i, before[j])
        np.minimum.at(roots, j, before[i])
        if (roots == before).all():
            return np.sort(ids)[roots]


def _compare(rows: pa.Table, table: int, tables: int, probes: int, cosine: float, out: list) -> None:
    """Links between the lookers and the owners of one pair of blocks: link counts and a spanning forest, never the list of pairs."""
    owner = rows.column("owner").to_numpy(zero_copy_only=False)
    sides = []
    for side in (rows.filter(pa.array(~owner)), rows.filter(pa.array(owner))):
        if not side.num_rows:
            return
        side = side.combine_chunks()
        vectors = side.column("vector").chunk(0)
        codes = side.column("codes").chunk(0).flatten().to_numpy().reshape(-1, tables, 1 + probes)
        sides.append((unit(vectors, len(vectors[0])), codes, side.column("node").to_numpy(), side.column("copies").to_numpy()))
    (a, code_a, id_a, copies_a), (b, code_b, id_b, copies_b) = sides
    i, j = np.nonzero(a @ b.T >= cosine)
    i, j = (x[id_a[i] != id_b[j]] for x in (i, j))
    # A pair counts in the first table in which it meets. Where both look into each other's bucket, the smaller id does.
    meets = lambda own, near: (own[:, :1] == near).any(axis=1)
    fresh = ~(meets(code_a[i, table], code_b[j, table]) & (id_a[i] > id_b[j]))
    for t in range(table):
        fresh &= ~meets(code_a[i, t], code_b[j, t]) & ~meets(code_b[j, t], code_a[i, t])
    i, j = i[fresh], j[fresh]
    if not len(i):
        return
    ids = np.concatenate([id_a, id_b])
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, copies_b[j])
    np.add.at(links, j + len(id_a), copies_a[i])
    # Rows that stand on both sides are one node.
    _, same = np.unique(ids, return_index=True)
    first = dict(zip(ids[same].tolist(), same.tolist(), strict=True))
    whole = np.array([first[x] for x in ids.tolist()])
    roots = _local_roots(whole[i], whole[j + len(id_a)], ids)[whole]
    linked = links > 0
    out.append(pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(links[linked]), pa.array(roots[linked])], ["node", "links", "root"]))


def _compared(tables: int, probes: int, cosine: float):
    """Rows come sorted by pair of blocks; one such pair is held at a time."""
    keys = ["label", "width", "table", "code", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = _starts(held, keys)
            yield from _pairs(held, starts[:-1], starts[1:])
            held = held.slice(starts[-1])
        if held is not None:
            yield from _pairs(held, [0], [held.num_rows])

    def _pairs(rows: pa.Table, starts, stops) -> list[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        for a, b in zip(starts, stops, strict=True):
            if b - a > 1:
                part = rows.slice(a, b - a)
                _compare(part, part.column("table")[0].as_py(), tables, probes, cosine, out)
        return out
    return run


def _starts(rows: pa.Table, keys: list[str]) -> list[int]:
    """Where each run of equal keys begins."""
    changed = np.zeros(rows.num_rows, bool)
    changed[0] = True
    for key in keys:
        x = rows.column(key).to_numpy()
        changed[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(changed).tolist()


def near_vectors(clips: DataFrame, cosine: float = 0.98, tables: int = 5, polytopes: int = 2, probes: int = 2, seed: int = 9) -> DataFrame:
    """Link vectors of equal label whose cosine, in double precision, is at least ``cosine``.

    ``clips(clip_id, vector array<float or double>, label)``; ``factor_vectors`` makes them of scored clips. Returns
    ``(clip_id, n_links bigint, component_id, kept boolean)``, one row per row: how many other vectors are linked directly, the
    smallest clip_id reachable by links, and whether it is the row's own.

    Equal vectors of a label are one class. ``tables`` times, a vector's bucket, among those of its label and length, is its nearest vertex of the cross-polytope in
    ``polytopes`` pseudo-random rotations (sign flips and Hadamard transforms); it also looks into the ``probes`` next buckets.
    Buckets are cut into blocks, each block of lookers meets each block of owners in one matrix product, and a pair counts in the first
    table where it meets. What leaves a pair of blocks are link counts and a spanning forest, so a bucket of any size is spread over
    tasks and no list of pairs is made. Every reported link is confirmed; the recall on the given tables is above 0.99.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without a label, link with nothing. Vectors
    of different length don't link. A NULL clip_id counts as larger than any other; repeated rows are linked with each other.
    """
    if probes > 2 * polytopes:
        raise ValueError("there are two probes per polytope at most")
    rows = clips.select("clip_id", F.col("vector").cast("array<double>").alias("vector"), "label")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
                       & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = cut_lineage(rows.filter("sound").groupBy("label", "vector").agg(F.min("clip_id").alias("first"), F.count("*").alias("copies"))
                          .withColumn("node", F.monotonically_increasing_id()))
    codes = cut_lineage(classes.select("node", "vector").mapInArrow(_coded(tables, polytopes, probes, seed), "node bigint, codes array<bigint>"))

    label = F.xxhash64("label").alias("label")
    width = F.size("vector").alias("width")
    looks = classes.select("node", label, width).join(codes, "node").select("node", "label", "width", F.posexplode("codes").alias("at", "code")).select(
        "node", "label", "width", F.floor(F.col("at") / (1 + probes)).cast("int").alias("table"), "code", (F.col("at") % (1 + probes) == 0).alias("owns"))
    bucket = ["label", "width", "table", "code"]
    sizes = looks.groupBy(*bucket).agg(F.count("*").alias("lookers"), F.count_if("owns").alias("owners")).filter("owners > 0 AND lookers > 1")
    placed = looks.join(sizes, bucket)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    lookers = placed.select("node", *bucket, F.lit(False).alias("owner"), own("lookers", 1).alias("i"), every("owners").alias("j"))
    owners = placed.filter("owns").select("node", *bucket, F.lit(True).alias("owner"), every("lookers").alias("i"), own("owners", 2).alias("j"))
    floats = classes.select("node", "vector", "copies").join(codes, "node")
    meetings = lookers.union(owners).join(floats, "node").repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")
    found = cut_lineage(meetings.mapInArrow(_compared(tables, probes, cosine), "node bigint, links bigint, root bigint"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    place = F.struct(F.col("first").isNull().alias("absent"), "first")
    known = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = known.groupBy("root").agg(F.min(place)["first"].alias("component_id"))
    known = known.join(firsts, "root").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "component_id",
                                              (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = rows.filter("sound").join(known, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))).select(
        "clip_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("clip_id", F.lit(0).cast("bigint").alias("n_links"), F.col("clip_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.col("clip_id").eqNullSafe(F.col("component_id")))

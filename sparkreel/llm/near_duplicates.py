"""Near-duplicate transcripts: SuperMinHash signatures, banding, links confirmed on whole shingle sets, union of groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.llm.graph import components
from sparkreel.llm.shingles import mixed, shingle_sets, text_slices
from sparkreel.session import cut_lineage

BANDS, ROWS = 21, 3
SLOTS = BANDS * ROWS
#: Texts that share a bucket get a longer signature, four bits a slot. Two whole sets are compared if at least AGREE slots agree,
#: five standard deviations below what a similarity of 0.8 gives.
LONG = 255
AGREE = 176
#: The same for the first four numbers, 64 slots.
SHORT, AGREE_SHORT = 4, 36
PIVOTS = 6
LONGS = (LONG + 1) // 16
LEVEL = np.uint64(32)
#: Further rounds of comparisons with a central member.
ROUNDS = 1
#: Shingles of a block of texts whose sets are compared with those of another block in one go.
BLOCK = 1 << 18
#: Texts of a group that are looked at one by one before their whole sets are.
FEW = 16
RANK_BITS = 20


def super_minhash(elements: np.ndarray, before: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit elements; ``before`` counts the elements before each set. Empty sets give all ones.

    Each element has a random permutation of the slots, drawn place by place (Fisher-Yates). Place by place, all elements offer
    place + r, r in [0, 1), to the slot that stands there, and a slot keeps its smallest offer: the ranks of one element are thus
    tied together, which lowers the variance. A set is done once all its slots are filled from places so far, as later offers are larger.
    """
    sets = len(before) - 1
    table = np.full(sets * slots, ~np.uint64(0), np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(before))
    order = None
    for place in range(slots):
        drawn = mixed(elements + np.uint64((place + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = place + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - place) >> LEVEL).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(elements))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, place]
        np.minimum.at(table, owner * slots + slot, np.uint64(place << 32) | drawn >> LEVEL)
        open_sets = (table.reshape(sets, slots).max(axis=1) >> LEVEL) > place
        left = open_sets[owner]
        if not left.any():
            break
        if order is None:
            elements, owner, pick = elements[left], owner[left], pick[left]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            order[np.arange(len(elements)), pick] = order[:, 0]
        elif left.mean() < 0.7:
            elements, owner, order = elements[left], owner[left], order[left]
    return table.reshape(sets, slots)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def _digests(sets: np.ndarray, before: np.ndarray) -> pa.Array:
    """A 128-bit digest of each set: two sums of scrambled elements, which don't depend on order."""
    n = np.diff(before)
    out = np.zeros((len(n), 2), np.uint64)
    filled = n > 0
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        if filled.any():
            out[filled, k] = mixed(np.add.reduceat(mixed(sets ^ np.uint64(salt)), before[:-1][filled]) + n[filled].astype(np.uint64))
    return pa.array([row.tobytes() for row in out], pa.binary())


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "transcript"):
            sets, before = shingle_sets(batch.column("transcript"), words)
            table = super_minhash(sets, before)
            keys = np.zeros((len(table), BANDS), np.uint64)
            for r in range(ROWS):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, r::ROWS])
            keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
            rows = len(table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("video_id"), pa.array(np.diff(before)), _digests(sets, before), _lists(keys.ravel(), np.full(rows, BANDS))],
                ["video_id", "n_shingles", "digest", "keys"])
    return run


def _planes(table: np.ndarray) -> np.ndarray:
    """Four bits of each slot, 64 slots in four numbers: the first holds the lowest bit of each of them, the last the highest."""
    slots = np.zeros((len(table), LONG + 1), np.uint8)
    slots[:, :LONG] = mixed(table) & np.uint64(15)
    bits = slots.reshape(-1, LONGS // 4, 1, 64) >> np.arange(4, dtype=np.uint8)[:, None] & 1
    return np.packbits(bits, axis=3, bitorder="little").reshape(len(table), 8 * LONGS).view("<u8")


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "transcript"):
            sets, before = shingle_sets(batch.column("transcript"), words)
            table = super_minhash(sets, before, LONG)
            yield pa.RecordBatch.from_arrays([_digests(sets, before), _lists(sets, np.diff(before)), _lists(_planes(table).ravel(), np.full(len(table), LONGS))],
                                             ["digest", "items", "packed"])
    return run


def _slot(items: np.ndarray) -> np.ndarray:
    return (mixed(items) >> np.uint64(64 - RANK_BITS)).astype(np.int64)


def _slot_ranks(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each of 2 ** RANK_BITS slots are, in eighths of a doubling up to 2 ** 31.

    That is a byte a slot, whatever the input; no more rows reach the driver, and no more bytes a task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            items = batch.column("items").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount(_slot(items), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    rank = (F.least(F.floor(F.log2(F.sum("n")) * 8), F.lit(255)) - 128).cast("tinyint")
    rows = sets.select("items").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(rank.alias("rank")).toArrow()
    out = np.zeros(1 << RANK_BITS, np.uint8)
    out[rows.column("slot").to_numpy()] = rows.column("rank").to_numpy().astype(np.int16) + 128
    return out


def _rarest(ranks: np.ndarray, percent: int):
    """Each set's rarest shingles, as many that two sets linked must share one (prefix filter)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("items")
            digests, shingles, places = [], [], []
            for digest, items in zip(batch.column("digest").to_pylist(), column, strict=True):
                own = items.values.to_numpy(zero_copy_only=False)
                n = len(own) - -(-percent * len(own) // 100) + 1
                shingles.append(own[np.lexsort((own, ranks[_slot(own.view(np.uint64))]))[:n]])
                digests.extend([digest] * n)
                places.append(np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.concatenate(shingles)), pa.array(np.concatenate(places), pa.int64())],
                                             ["digest", "shingle", "place"])
    return run


def _compared(percent: int):
    """Strays against the members of a group, block by block; rows come sorted by block pair, one of which is held at a time."""
    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        stray = rows.column("stray").to_numpy(zero_copy_only=False)
        left, right = rows.filter(pa.array(stray)), rows.filter(pa.array(~stray)).combine_chunks()
        if not left.num_rows or not right.num_rows:
            return
        items = right.column("items").chunk(0)
        flat, sizes = items.flatten().to_numpy().view(np.uint64), np.diff(items.offsets.to_numpy())
        starts, names = np.cumsum(sizes) - sizes, right.column("digest").to_pylist()
        for digest, own in zip(left.column("digest").to_pylist(), left.column("items").to_pylist(), strict=True):
            own = np.array(own, np.int64).view(np.uint64)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), starts)
            to = [names[k] for k in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common))]
            if to:
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(to), pa.binary()), pa.array(to, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            task = held.column("task").to_numpy()
            root = held.column("root").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (root[1:] != root[:-1])) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from links(held.slice(a, b - a))
            held = held.slice(cuts[-1])
        if held is not None:
            yield from links(held)
    return run


def _agreeing(a: Column, b: Column, longs: int = LONGS) -> Column:
    """Slots of the long signatures, or of their first ``longs`` numbers, whose four bits agree.

    Every number is read once; an expression that repeats them is written out again in each plan that holds it.
    """
    differing = [F.bit_count(reduce(Column.bitwiseOR, [a[k].bitwiseXOR(b[k]) for k in range(at, at + 4)])) for at in range(0, longs, 4)]
    return F.lit(min(16 * longs, LONG)) - reduce(Column.__add__, differing)


def near_duplicates(transcripts: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Group transcripts whose word-shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    ``transcripts(video_id, transcript)``. Returns ``(video_id, n_shingles bigint, component_id, kept boolean)``, one row per row:
    the size of the set, the smallest video_id reachable by links, and whether it is the row's own.

    Equal sets are one class from the start, so copies cost one row each. Classes meet where one of 21 bands of three SuperMinHash slots
    agrees (a pair at 0.8 is missed with probability 7e-7). In a bucket no list of pairs is made. First all members are compared
    with a central one, the likely source of the others; then, where a bucket still holds several groups, with a central one of those
    outside the largest. What is then outside a bucket's largest group is compared with all members of every group it shares one of its
    rarest shingles with (a link can't do without), in blocks that yield nothing but links. A pair is linked or not on its whole
    sets; of pairs of single texts only those are passed over whose long signatures agree too little, by five standard deviations. So
    all links that matter for the groups are found, and a group of copies costs work in proportion.

    NULL and empty transcripts, or such without words, have an empty set and are linked with nothing. Texts of fewer than ``words``
    words have one shingle, the whole sequence. A NULL video_id counts as larger than any other; rows with equal ids are rows of their own. ``percent`` is 80 or more.
    """
    if percent < 80:
        raise ValueError("bands and agreement bounds are those of a similarity of 80 percent and more")
    rows = transcripts.select("video_id", "transcript")
    id_type = rows.schema["video_id"].dataType.simpleString()
    signed = cut_lineage(rows.mapInArrow(
        _signed(words), f"video_id {id_type}, n_shingles bigint, digest binary, keys array<bigint>"))
    filled = signed.filter("n_shingles > 0")
    classes = filled.groupBy("digest").agg(F.min("video_id").alias("first"), F.first("keys").alias("keys"))
    members = classes.select("digest", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    members = cut_lineage(members.join(shared.select("key"), "key").select("key", "digest"))

    needed = members.select("digest").distinct().join(classes.select("digest", "first"), "digest")
    ids = needed.select(F.col("first").alias("_id")).distinct()
    texts = rows.join(ids, F.col("video_id").eqNullSafe(F.col("_id")), "left_semi").select("transcript")
    sets = texts.mapInArrow(_whole_sets(words), "digest binary, items array<bigint>, packed array<bigint>")
    sets = cut_lineage(sets.join(needed.select("digest"), "digest").groupBy("digest").agg(
        *[F.first(c).alias(c) for c in ("items", "packed")], F.first(F.size("items")).alias("n")))
    packs = sets.select("digest", "packed", "n")

    # Every step is written by itself: a plan of many joins is kept, planned anew and described on the driver as often as one of its stages ends.
    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)`` the links."""
        side = lambda df, name, value: df.select(F.col("digest").alias(name), F.col(value).alias(f"{value}_{name}"))
        close = cut_lineage(pairs).join(side(packs, "a", "packed"), "a").join(side(packs, "b", "packed"), "b").filter(
            _agreeing(F.col("packed_a"), F.col("packed_b")) >= AGREE).select("a", "b").distinct()
        both = cut_lineage(close).join(side(sets, "b", "items"), "b").join(side(sets, "a", "items"), "a")
        common = F.size(F.array_intersect("items_a", "items_b"))
        union = F.size("items_a") + F.size("items_b") - common
        return both.filter(F.lit(100).cast("bigint") * common >= F.lit(percent) * union).select("a", "b")

    def grouped(links: DataFrame) -> DataFrame:
        roots = components(links)
        return members.join(roots, members.digest == roots.node, "left").select("key", "digest", F.coalesce("root", "digest").alias("root"))

    def central(rows: DataFrame) -> DataFrame:
        """Per bucket the member that agrees most with PIVOTS members drawn at random: ``(key, a, root_a)``.

        In a group of copies that is the text they were made from, which is linked with most of them.
        """
        drawn = rows.groupBy("key").agg(*[F.min_by("brief", F.xxhash64("digest", "key", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
        score = sum((_agreeing(F.col("brief"), F.col(f"p{k}"), SHORT) for k in range(1, PIVOTS)), _agreeing(F.col("brief"), F.col("p0"), SHORT))
        return rows.join(cut_lineage(drawn), "key").groupBy("key").agg(F.max_by(F.struct("digest", "root"), F.struct(score.alias("s"), "digest")).alias("c")).select(
            "key", F.col("c.digest").alias("a"), F.col("c.root").alias("root_a"))

    def outside(rows: DataFrame) -> DataFrame:
        """Of the buckets that hold several groups, the members outside the largest."""
        sizes = rows.groupBy("key", "root").count()
        largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("groups"))
        return rows.join(largest.filter("groups > 1").select("key", "most"), "key").filter("root <> most").drop("most")

    def against(rows: DataFrame, centres: DataFrame) -> DataFrame:
        return rows.join(centres, "key").filter("root <> root_a").select("a", F.col("digest").alias("b")).distinct()

    brief = packs.select("digest", "n", F.slice("packed", 1, SHORT).alias("brief"))
    alone = members.join(brief.drop("n"), "digest").withColumn("root", F.col("digest"))
    alone = cut_lineage(alone)
    links = cut_lineage(confirmed(against(alone, central(alone))))
    for _ in range(ROUNDS):
        now = cut_lineage(grouped(links).join(brief.drop("n"), "digest"))
        links = cut_lineage(links.union(confirmed(against(now, central(cut_lineage(outside(now)))))))

    now = cut_lineage(grouped(links))
    shared_out = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    opened = now.join(shared_out, "key").select("digest").distinct()
    strays = cut_lineage(outside(now).select("digest").distinct())
    roots = cut_lineage(now.select("digest", "root").distinct())
    rare = cut_lineage(sets.join(opened, "digest", "left_semi").mapInArrow(_rarest(_slot_ranks(sets), percent), "digest binary, shingle bigint, place bigint"))
    # A group is met only if the size and the first slots of the signature of one of its texts that hold the shingle allow a link; they
    # ride along with its shingles. Of groups of many texts only the range of sizes does.
    sizes = cut_lineage(roots.join(brief.select("digest", "n"), "digest").groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total")))
    facts = cut_lineage(roots.join(sizes, "root").join(brief, "digest").select("digest", "root", "size", "n", "brief"))
    own = strays.join(facts, "digest").select(
        F.col("digest").alias("stray"), F.col("root").alias("own_root"), F.col("n").alias("own_n"), F.col("brief").alias("own_brief"))
    kept = rare.join(own, F.col("digest") == F.col("stray")).drop("digest")
    marks = rare.join(facts, "digest").groupBy("root", "shingle").agg(
        F.first("size").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") * 100 - F.col("place") * (100 + percent)).alias("reach"), F.first(F.when(F.col("size") == 1, F.col("brief"))).alias("brief"),
        F.collect_list(F.when(F.col("size").between(2, FEW), F.struct("n", "brief"))).alias("texts"))

    def alike(n: Column, of: Column) -> Column:
        close = F.least("own_n", n) * 100 >= F.greatest("own_n", n) * percent
        return close & (_agreeing(F.col("own_brief"), of, SHORT) >= AGREE_SHORT)

    # Two linked sets share nothing before their first common shingle, and percent / (100 + percent) of both sizes from there on, so
    # there it can't stand late in either.
    in_range = ((F.col("own_n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("own_n") * percent)
                & (F.col("own_n") * 100 - F.col("place") * (100 + percent) >= F.col("low") * percent) & (F.col("reach") >= F.col("own_n") * percent))
    allowed = in_range & F.when(F.col("size") == 1, alike(F.col("low"), F.col("brief"))).when(
        F.col("size") <= FEW, F.exists("texts", lambda t: alike(t["n"], t["brief"]))).otherwise(True)
    met = kept.join(marks.withColumnRenamed("shingle", "mark"), (F.col("shingle") == F.col("mark")) & (F.col("root") != F.col("own_root")) & allowed)
    # Before whole sets are sent, the long signatures of single texts are compared.
    single = roots.join(sizes.filter("size = 1"), "root").join(packs, "digest").select("root", F.col("packed").alias("root_packed"))
    met = cut_lineage(met.select("stray", "root", "size").distinct()).join(single, "root", "left").join(packs.withColumnRenamed("digest", "stray"), "stray")
    met = cut_lineage(met.filter((F.col("size") > 1) | (_agreeing(F.col("packed"), F.col("root_packed")) >= AGREE)).select("stray", "root", "n"))

    counts = cut_lineage(met.groupBy("root").agg(F.sum("n").alias("strays")).join(sizes.select("root", "total"), "root"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda name, n: F.pmod(F.xxhash64(name), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = met.select("root", "stray").join(counts, "root").select(F.col("stray").alias("digest"), "root", F.lit(True).alias("stray"), own("stray", "strays").alias("i"), every("total").alias("j"))
    right = roots.join(counts, "root").select("digest", "root", F.lit(False).alias("stray"), every("strays").alias("i"), own("digest", "total").alias("j"))
    task = F.xxhash64("root", "i", "j").alias("task")
    meetings = left.union(right).select("digest", "root", "stray", task).join(sets.select("digest", "items"), "digest")
    found = meetings.repartition("task", "root").sortWithinPartitions("task", "root").mapInArrow(_compared(percent), "a binary, b binary")
    links = links.union(cut_lineage(found))

    roots = components(links)
    place = F.struct(F.col("first").isNull().alias("absent"), "first")
    grouping = classes.select("digest", "first").join(roots, F.col("digest") == F.col("node")).select("digest", "first", "root")
    firsts = grouping.groupBy("root").agg(F.min(place)["first"].alias("lowest"))
    lowest = cut_lineage(grouping.join(firsts, "root").select("digest", "lowest"))
    firsts = classes.select("digest", "first").join(lowest, "digest", "left").select(
        "digest", F.coalesce("lowest", "first").alias("component_id"))
    named = filled.select("video_id", "n_shingles", "digest").join(firsts, "digest").select("video_id", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0").select("video_id", "n_shingles", F.col("video_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.col("video_id").eqNullSafe(F.col("component_id")))

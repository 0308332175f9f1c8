"""Text that repeats across transcripts: equal byte strings found by sorting suffixes, and what is left without them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.llm import suffixes
from sparkreel.llm.manifest import numbered
from sparkreel.llm.shingles import FACTOR, mixed, text_buffer, text_slices
from sparkreel.session import cut_lineage, shared_dir

#: Bytes of an anchor: of the strings of this length inside a window, the one of the least hash marks it.
ANCHOR = 16
#: Windows a strip holds at most, one bit each.
STRIP = 64
#: Bytes of text that give the anchors, and the strips, of one part.
ANCHOR_PART, STRIP_PART = 32 << 20, 4 << 20
#: Window starts handled at once.
PIECE = 1 << 21
#: Bytes of strips gathered before they are sent.
GATHERED = 16 << 20
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Packing:
    """Compression of texts and strips with words of the corpus at hand; it says nothing about what repeats."""

    def __init__(self, words: bytes):
        shared = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        if shared:
            shared.precompute_compress(level=3)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=shared).compress
        self.plain = zstandard.ZstdDecompressor(dict_data=shared).decompress


def _anchors(raw: np.ndarray, length: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece, the first window start and hashes of ``width`` bytes of the anchors of the windows from there on."""
    span = length - ANCHOR + 1
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        piece = raw[at:at + PIECE + length - 1]
        words = np.ndarray(len(piece) - 7, "<u8", np.ascontiguousarray(piece), strides=(1,))
        low = mixed(words[:-8] * FACTOR ^ words[8:] * OTHER) >> np.uint64(64 - 8 * width)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[:step - span], low[span - step:])
        yield at, low


def _part(anchors: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(anchors) % np.uint64(parts)).astype(np.int32)


def _narrow(values: np.ndarray, width: int) -> bytes:
    """Numbers in ``width`` bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").copy()


FOUND = "part int, kind int, keys binary, sizes binary, anchors binary"
ALONE, KNOWN, WITNESS = 0, 1, 2


def _listed(length: int, parts: int, width: int):
    """Anchors of slices of texts, dealt by anchor: those of one text of the slice (ALONE), and a WITNESS of each that several texts
    share, which is KNOWN to be shared and travels by text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "transcript"):
            raw, offsets = text_buffer(batch.column("transcript"))
            keys, seen, texts, anchors = batch.column("key").to_pylist(), set(), [], []
            for i, key in enumerate(keys):
                if key not in seen and offsets[i + 1] - offsets[i] >= length:
                    seen.add(key)
                    own = [low[np.concatenate([[True], low[1:] != low[:-1]])] for _, low in _anchors(raw[offsets[i]:offsets[i + 1]], length, width)]
                    texts.append(key)
                    anchors.append(np.unique(np.concatenate(own)))
            if not texts:
                continue
            names = np.array(texts, "V16")
            text = np.repeat(np.arange(len(texts)), [len(a) for a in anchors])
            every = np.concatenate(anchors)
            order = np.argsort(every, kind="stable")
            text, every = text[order], every[order]
            first = np.concatenate([[True], every[1:] != every[:-1]])
            alone = first & np.concatenate([first[1:], [True]])

            def rows(kind: int, part: np.ndarray, text: np.ndarray, anchor: np.ndarray) -> Iterator[tuple]:
                by = np.lexsort((text, part))
                part, text, anchor = part[by], text[by], anchor[by]
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
                for a, b in zip(cuts, cuts[1:]):
                    own, sizes = np.unique(text[a:b], return_counts=True)
                    yield int(part[a]), kind, names[own].tobytes(), sizes.astype("<u4").tobytes(), _narrow(anchor[a:b], width)

            out = [*rows(ALONE, _part(every[alone], parts), text[alone], every[alone])]
            spread = _part(np.arange(len(texts), dtype=np.uint64) + np.uint64(int.from_bytes(texts[0][:6], "little")), parts)
            out += rows(KNOWN, spread[text[~alone]], text[~alone], every[~alone])
            common = every[first & ~alone]
            out += [(p, k, b"", b"", a) for p, k, _, _, a in rows(WITNESS, _part(common, parts), np.zeros(len(common), np.int64), common)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                             ["part", "kind", "keys", "sizes", "anchors"])
    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of each run of equal ``key``; the tables here give a part's rows a bounded size."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_bucket(names: np.ndarray, text: np.ndarray, anchor: np.ndarray, parts: int, width: int) -> pa.RecordBatch:
    """Anchors of texts, dealt by text: one row for each bucket of texts."""
    own, index, sizes = np.unique(text, return_inverse=True, return_counts=True)
    bucket = names[own].view("<u4").reshape(-1, 4)[:, 0] % parts
    order = np.lexsort((index, bucket[index]))
    anchor, by = anchor[order], np.argsort(bucket, kind="stable")
    own, sizes, bucket = own[by], sizes[by], bucket[by]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(own)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(int(bucket[a]), names[own[a:b]].tobytes(), sizes[a:b].astype("<u4").tobytes(), _narrow(anchor[ends[a]:ends[b]], width)) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                      ["bucket", "keys", "sizes", "anchors"])


def _gathered(width: int):
    """Of each bucket the shared anchors of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket"):
            sizes = np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in rows]).astype(np.int64)
            name, index = np.unique(np.concatenate([np.frombuffer(r["keys"], "V16") for r in rows]), return_inverse=True)
            anchor = _wide(b"".join(r["anchors"] for r in rows), width)
            text = np.repeat(index, sizes)
            order = np.argsort(text, kind="stable")
            cuts = np.cumsum(np.bincount(text, minlength=len(name)))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in name], pa.binary()),
                                              pa.array([_narrow(a, width) for a in np.split(anchor[order], cuts)], pa.binary())], ["key", "anchors"])
    return run


def _judged(width: int, parts: int):
    """Of each part the anchors that stand in several texts, by text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "part"):
            names, texts, anchors, flags, before = [], [], [], [], 0
            for row in rows:
                anchor = _wide(row["anchors"], width)
                own = np.frombuffer(row["keys"], "V16")
                text = np.repeat(np.arange(len(own)), np.frombuffer(row["sizes"], "<u4"))
                if row["kind"] == KNOWN:
                    yield _by_bucket(own, text, anchor, parts, width)
                    continue
                names.append(own)
                texts.append(text + before if len(own) else np.full(len(anchor), -1))
                anchors.append(anchor)
                before += len(own)
            if not anchors:
                continue
            name, index = np.unique(np.concatenate(names), return_inverse=True)
            text, anchor = np.concatenate(texts), np.concatenate(anchors)
            text = np.where(text >= 0, index[text], -1) if len(index) else text
            order = np.lexsort((text, anchor))
            text, anchor = text[order], anchor[order]
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            fresh = first | np.concatenate([[True], text[1:] != text[:-1]])
            text, anchor, first = text[fresh], anchor[fresh], first[fresh]
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, len(first)))
            shared = np.repeat((size > 1) | (text[starts] < 0), size) & (text >= 0)
            if shared.any():
                yield _by_bucket(name, text[shared], anchor[shared], parts, width)
    return run


def _packed(words: bytes):
    """Texts compressed, as they are sent twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packing(words).pack
        for batch in text_slices(batches, "transcript"):
            raw, offsets = text_buffer(batch.column("transcript"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([pack(raw[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.binary())],
                                             ["key", "packed"])
    return run


def _strips(length: int, parts: int, width: int, words: bytes):
    """Strips of windows with a shared anchor, dealt by anchor: equal windows meet in one part, whatever stands around them."""
    def flush(held: list[tuple], pack) -> Iterator[pa.RecordBatch]:
        part, number, lead, start, count = (np.concatenate([x[k] for x in held]) for k in range(5))
        raw = b"".join([x[5] for x in held])
        size = count + length - 1
        stops = np.cumsum(size)
        strips: dict[bytes, int] = {}
        which = np.array([strips.setdefault(raw[b - n:b], len(strips)) for b, n in zip(stops.tolist(), size.tolist())], np.int64)
        first = np.full(len(strips), np.iinfo(np.int64).max)
        np.minimum.at(first, which, lead)
        # A text that holds a strip of an earlier one loses all its windows; the earliest is judged among all parts.
        judged = lead == first[which]
        raw, names, blobs = np.frombuffer(raw, np.uint8), [], []
        for kind, rows in ((True, np.flatnonzero(judged)), (False, np.flatnonzero(~judged))):
            rows = rows[np.argsort(part[rows], kind="stable")]
            cuts = [0, *(np.flatnonzero(np.diff(part[rows])) + 1).tolist(), len(rows)] if len(rows) else []
            for a, b in zip(cuts, cuts[1:]):
                own = rows[a:b]
                data = [number[own].astype("<i8"), lead[own].astype("<i8"), start[own].astype("<u4"), count[own].astype("<u1")]
                if kind:
                    data.append(raw[np.repeat(stops[own] - np.cumsum(size[own]), size[own]) + np.arange(size[own].sum())])
                names.append(int(part[own[0]] if kind else number[own[0]] % parts))
                blobs.append((kind, pack(b"".join([len(own).to_bytes(8, "little"), *[d.tobytes() for d in data]]))))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([k for k, _ in blobs]), pa.array([d for _, d in blobs], pa.binary())],
                                         ["part", "judged", "strips"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, codec = [], 0, Packing(words)
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(codec.plain(row["packed"]), np.uint8)
                shared = np.unique(_wide(row["anchors"], width))
                for at, low in _anchors(raw, length, width):
                    hit = shared[np.minimum(np.searchsorted(shared, low), len(shared) - 1)] == low
                    new = np.concatenate([[True], low[1:] != low[:-1]])
                    place = np.arange(len(low))
                    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % STRIP == 0
                    first = np.flatnonzero(new)
                    count = np.diff(np.append(first, len(low)))
                    keep = hit[first]
                    first, count = first[keep], count[keep]
                    size = count + length - 1
                    pick = np.repeat(at + first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    n = len(first)
                    held.append((_part(low[first], parts), np.full(n, row["number"]), np.full(n, row["lead"]), at + first, count, raw[pick].tobytes()))
                    total += len(pick)
                    if total >= GATHERED:
                        yield from flush(held, codec.pack)
                        held, total = [], 0
        if total:
            yield from flush(held, codec.pack)
    return run


def _repeats(length: int, folder: str, budget: int, words: bytes):
    """Per part: the distinct strips' suffixes in order, the first transcript of each group of equal windows, and for each text the
    windows that an earlier transcript holds."""
    def sent(number: np.ndarray, start: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(number, kind="stable")
        own, cuts = np.unique(number[order], return_index=True)
        sizes = pa.array(np.append(cuts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(sizes, pa.array(x[order].astype(np.int64))) for x in (start, masks.view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(own), *lists], ["number", "starts", "masks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Packing(words).plain
        for rows in _runs(batches, "part"):
            strips: dict[bytes, int] = {}
            members = []
            for row in rows:
                data = plain(row["strips"])
                n = int.from_bytes(data[:8], "little")
                number, lead = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
                start, count = np.frombuffer(data, "<u4", n, 8 + 16 * n), np.frombuffer(data, "<u1", n, 8 + 20 * n).astype(np.int64)
                if not row["judged"]:
                    yield sent(number, start, ~np.uint64(0) >> (STRIP - count).astype(np.uint64))
                    continue
                cuts = (np.concatenate([[0], np.cumsum(count + length - 1)]) + 8 + 21 * n).tolist()
                which = np.array([strips.setdefault(data[a:b], len(strips)) for a, b in zip(cuts, cuts[1:])], np.int64)
                members.append((number, lead, start, which))
            if not members:
                continue
            names = list(strips)
            count = np.array([len(s) - length + 1 for s in names], np.int64)
            lead = np.full(len(names), np.iinfo(np.int64).max)
            for _, own, _, which in members:
                np.minimum.at(lead, which, own)
            string, at, group = suffixes.equal_windows(names, length, folder, budget)
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            least = np.repeat(np.minimum.reduceat(lead[string], begins), np.diff(np.append(begins, len(group))))
            before = np.cumsum(count) - count
            first = np.empty(int(count.sum()), np.int64)
            first[before[string] + at] = least
            for number, own, start, which in members:
                n = count[which]
                ends = np.cumsum(n)
                bit = np.arange(ends[-1]) - np.repeat(ends - n, n)
                late = first[np.repeat(before[which], n) + bit] < np.repeat(own, n)
                masks = np.bitwise_or.reduceat(late.astype(np.uint64) << bit.astype(np.uint64), ends - n)
                some = masks != 0
                if some.any():
                    yield sent(number[some], start[some], masks[some])
    return run


def _cut(length: int, words: bytes):
    """Texts without the bytes of the marked windows: maximal runs and the bytes that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Packing(words).plain
        for batch in batches:
            out = []
            marks = batch.column("marks")
            for i, row in enumerate(batch.select(["key", "packed"]).to_pylist()):
                raw = plain(row["packed"])
                start, mask = (marks[i].values.field(c).flatten().to_numpy() for c in ("starts", "masks"))
                whole = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, bit = np.nonzero(whole)
                at = np.unique(start[which] + bit)
                new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + length]))
                first, stop = at[new], np.append(at[new[1:] - 1], at[-1]) + length
                edges = [0, *np.column_stack([first, stop]).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((row["key"], len(raw) - len(kept), len(first), kept, first.tolist(), stop.tolist()))
            if out:
                key, removed, spans, kept, first, stop = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                     pa.array(first, pa.list_(pa.int64())), pa.array(stop, pa.list_(pa.int64()))], ["key", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])
    return run


def _place(column: str) -> Column:
    """Orders ids, NULL after all others."""
    return F.struct(F.col(column).isNull().alias("absent"), F.col(column).alias("id"))


def repeated_text(transcripts: DataFrame, length: int = 50, budget: int = suffixes.BUDGET) -> DataFrame:
    """The bytes of each transcript that an earlier one holds too: those covered by a string of ``length`` bytes that also starts in a
    transcript of a smaller video_id.

    ``transcripts(video_id, transcript)``. Returns, one row per row, ``(video_id, n_bytes bigint, n_removed bigint, n_spans bigint,
    kept_sha256, starts, stops)``: UTF-8 bytes, bytes to remove, their maximal runs [start, stop) and the SHA-256 of the rest. Strings
    are judged on the input; overlaps count; matches don't cross transcripts.

    Equal texts are one class, which costs one text. Of each window of ``length`` bytes the 16 bytes of the least hash are its anchor, so
    equal windows have equal anchors; windows whose anchor stands in one text only can't repeat, and are left out. The others
    are cut into strips of windows of one anchor and dealt by it. In each part the suffixes of the distinct strips are sorted by external
    induced sorting (``suffixes``), whose common-prefix values give the groups of equal windows; tuples beyond ``budget`` bytes wait
    in files of the shared folder. The number of parts follows the bytes of text, so that a part holds as much whatever the input.

    A NULL transcript is empty; texts shorter than ``length`` lose nothing. A NULL video_id counts as larger than any other, and rows with
    equal ids (or without) take nothing from each other. ``length`` is at least 32 and at most 200.
    """
    if not 2 * ANCHOR <= length <= 200:
        raise ValueError("length must be from 32 to 200")
    spark = transcripts.sparkSession
    folder = shared_dir(spark)
    rows = transcripts.select("video_id", F.coalesce("transcript", F.lit("")).alias("transcript")).withColumn("key", F.unhex(F.md5(F.col("transcript").cast("binary"))))
    each = cut_lineage(rows.select("video_id", "key", F.octet_length("transcript").cast("bigint").alias("n_bytes"),
                                   F.sha2(F.col("transcript").cast("binary"), 256).alias("whole")))
    size = each.agg(F.sum("n_bytes")).first()[0] or 0
    parts = lambda of: int(-(-size // of)) + 1
    # Different anchors look equal to about one in ten thousand, whatever the input; that costs a comparison and changes no result.
    width = min(8, -(-(size.bit_length() + 10) // 8))

    classes = each.groupBy("key").agg(F.min(_place("video_id")).alias("first"), F.first("n_bytes").alias("n_bytes"), F.first("whole").alias("whole"))
    spread = numbered(classes.select("key", "first"), ["first", "key"])
    counts = spread.groupBy("_part").count().collect()  # a row for each partition
    before, total = {}, 0
    for part, n in sorted(counts):
        before[part], total = total, total + n
    offsets = spark.createDataFrame(list(before.items()), "_part int, _offset bigint")
    spread = cut_lineage(spread.join(F.broadcast(offsets), "_part").select("key", "first", (F.col("_offset") + F.col("_at")).alias("number")))
    leads = spread.groupBy("first").agg(F.min("number").alias("lead"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    spread = cut_lineage(spread.join(leads, "first", "left").select("key", "first", "number", F.coalesce("lead", "number").alias("lead")))

    texts = rows.filter(F.octet_length("transcript") >= length).select("key", "transcript")
    # A few texts whose words help to compress the others; results don't depend on them.
    words = "".join(r[0] for r in texts.select(F.substring("transcript", 1, 4096)).limit(32).collect()).encode()
    listed = texts.mapInArrow(_listed(length, parts(ANCHOR_PART), width), FOUND)
    judged = listed.repartition("part").sortWithinPartitions("part").mapInArrow(
        _judged(width, parts(ANCHOR_PART)), "bucket bigint, keys binary, sizes binary, anchors binary")
    shared = cut_lineage(judged.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gathered(width), "key binary, anchors binary"))
    distinct = texts.mapInArrow(_packed(words), "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    strips = distinct.join(shared, "key").join(spread.select("key", "number", "lead"), "key").mapInArrow(
        _strips(length, parts(STRIP_PART), width, words), "part int, judged boolean, strips binary")
    marks = strips.repartition("part").sortWithinPartitions("part").mapInArrow(
        _repeats(length, folder, budget, words), "number bigint, starts array<bigint>, masks array<bigint>")
    marks = cut_lineage(marks.groupBy("number").agg(F.collect_list(F.struct("starts", "masks")).alias("marks")))
    marked = marks.join(spread.select("key", "number"), "number").drop("number")
    cut = distinct.join(marked, "key").mapInArrow(
        _cut(length, words), "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, stops array<bigint>")

    known = cut_lineage(spread.select("key", "first").join(cut, "key", "left"))
    joined = each.join(known, "key")
    copy = ~_place("video_id").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<bigint>")
    one = lambda value: F.array(value.cast("bigint"))
    return joined.select(
        "video_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, one(F.lit(0))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(copy, one(F.col("n_bytes"))).otherwise(F.coalesce("stops", none)).alias("stops"))

"""Packing transcripts into training windows with the neighbours that BM25 retrieves for them."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from sparkreel.llm.shingles import mixed
from sparkreel.session import cut_lineage

#: Fixed value: how a text is split before byte pairs are merged.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 1
K1, B = 1.2, 0.75
_encoders: dict[str, tiktoken.Encoding] = {}


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a vocabulary file, read once per process. It yields the ids of ``byte_bpe_50k.json`` without special
    tokens; their strings in a text are ordinary text."""
    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("clips", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _encoded(path: str, window: int):
    """Per transcript its full windows and, of what remains, the ids and a key that brings like remainders together. A last row per task,
    with ``row`` -1, holds in how many of its transcripts each token stands."""
    names = ["video_id", "row", "tokens", "crcs", "ids", "near", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        found = np.zeros(1 << 16, "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("full", "tokens", "ids", "near")}
                crcs: list[list[int]] = []
                for text in part.column("transcript").to_pylist():
                    ids = np.array([*tokens.encode_ordinary(text or ""), END], "<u4")
                    found[np.unique(ids)] += 1
                    full = len(ids) // window
                    rest = ids[full * window:]
                    crcs.append([zlib.crc32(ids[k * window:(k + 1) * window].tobytes()) for k in range(full)])
                    out["full"].append(full)
                    out["tokens"].append(len(ids))
                    out["ids"].append(rest.tobytes())
                    # The smallest hashes of token pairs: texts with much in common sort next to each other.
                    pairs = mixed(rest[:-1].astype(np.uint64) << np.uint64(32) | rest[1:].astype(np.uint64))
                    out["near"].append(int(pairs.min() >> np.uint64(1)) if len(pairs) else 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("video_id"), part.column("row"), pa.array(out["tokens"], pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                     pa.array(out["ids"], pa.binary()), pa.array(out["near"], pa.int64()), pa.nulls(part.num_rows, pa.binary())], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((None, pa.int64()), (-1, pa.int64()), (0, pa.int64()), ([], pa.list_(pa.int64())), (b"", pa.binary()), (0, pa.int64()),
                                           (zlib.compress(found.tobytes(), 1), pa.binary()))], names)
    return run


class Shard:
    """An inverted BM25 index over the remainders of one shard. ``idf`` holds the weight of each token in the whole corpus, ``average``
    the length of its documents (without it, that of ``docs``).

    Tokens of more than an eighth of the documents are rows of a matrix, which has at most eight places per token of the shard.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, average: float | None = None):
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), lengths)
        key, count = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        term, self.doc = key // len(docs), key % len(docs)
        scale = K1 * (1 - B + B * lengths / (average or lengths.mean()))
        self.weight = (idf[term] * count * (K1 + 1) / (count + scale[self.doc])).astype(np.float32)
        self.bounds = np.searchsorted(term, np.arange(len(idf) + 1))
        self.size = len(docs)
        common = np.flatnonzero(8 * np.diff(self.bounds) > self.size)
        self.place = np.full(len(idf), -1)
        self.place[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.size), np.float32)
        dense = self.place[term] >= 0
        self.matrix[self.place[term[dense]], self.doc[dense]] = self.weight[dense]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for the distinct tokens of ``query``."""
        terms = np.unique(query)
        asked = np.zeros(len(self.matrix), np.float32)
        asked[self.place[terms[self.place[terms] >= 0]]] = 1
        out = (asked @ self.matrix).astype(float)
        terms = terms[self.place[terms] < 0]
        spans = [slice(a, b) for a, b in zip(self.bounds[terms].tolist(), self.bounds[terms + 1].tolist(), strict=True)]
        if not spans:
            return out
        return out + np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=self.size)


def fill_windows(docs: list[np.ndarray], idf: np.ndarray, window: int, average: float | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length). The longest unused document is the seed; its unused neighbours follow by BM25,
    and the one that no longer fits is cut, its rest staying unused. Only the last window can be short."""
    shard = Shard(docs, idf, average)
    left = np.array([len(d) for d in docs])
    start = np.zeros(len(docs), np.int64)
    order = np.argsort(-left, kind="stable")
    windows, at = [], 0
    while True:
        while at < len(order) and left[order[at]] == 0:
            at += 1
        if at == len(order):
            return windows
        seed = order[at]
        scores = shard.scores(docs[seed])
        scores[left == 0] = -1
        scores[seed] = np.inf
        room, pieces = window, []
        ranked = np.argsort(-scores, kind="stable") if room > left[seed] else [seed]
        for doc in ranked:
            if room == 0:
                break
            if left[doc]:
                taken = min(room, int(left[doc]))
                pieces.append((int(doc), int(start[doc]), taken))
                start[doc] += taken
                left[doc] -= taken
                room -= taken
        windows.append(pieces)


def _packed(statistics, window: int, capacity: int):
    """Rows come in shard order; a shard ends when it holds ``capacity`` tokens, so one shard is held at a time."""
    def flush(rows: list[tuple], part: int, number: int, idf: np.ndarray, average: float) -> pa.RecordBatch:
        docs = [np.frombuffer(r[3], "<u4") for r in rows]
        out: dict[str, list] = {k: [] for k in ("video_id", "row", "start", "length", "ids_crc32", "tokens", "part", "window", "offset")}
        for k, pieces in enumerate(fill_windows(docs, idf, window, average)):
            offset = 0
            for doc, start, length in pieces:
                video, row, tokens, _ = rows[doc]
                full = tokens // window * window
                values = (video, row, full + start, length, zlib.crc32(docs[doc][start:start + length].tobytes()), tokens, part, number + k, offset)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
                offset += length
        return pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("video_id", pa.int64()), *[(k, pa.int64()) for k in ("row", "start", "length", "ids_crc32", "tokens", "part", "window", "offset")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, average = statistics.value
        rows, held, number, part = [], 0, 0, 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("video_id", "row", "tokens", "ids", "part")], strict=True):
                part = row[4]
                rows.append(row[:4])
                held += len(row[3]) // 4
                if held >= capacity:
                    out = flush(rows, part, number, idf, average)
                    yield out
                    number += out.column("window")[-1].as_py() - number + 1
                    rows, held = [], 0
        if rows:
            yield flush(rows, part, number, idf, average)
    return run


def corpus_statistics(encoded: DataFrame) -> tuple[np.ndarray, float]:
    """BM25 weight of each token id, and the average length, over the whole token sequences of all transcripts. Every token weighs
    something, however common. 65,536 rows reach the driver at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for found in batch.column("found").to_pylist():
                total += np.frombuffer(zlib.decompress(found), "<u4")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = encoded.filter("row < 0").select("found").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect()
    docs, average = encoded.filter("row >= 0").agg(F.count("*"), F.avg("tokens")).first()
    df = np.zeros(1 << 16)
    for token, n in counts:
        df[token] = n
    return np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32), average or 1.0


def pack(transcripts: DataFrame, window: int = 2048, capacity: int = 1 << 20, vocabulary: str | None = None) -> DataFrame:
    """Pack all transcripts into token windows, each filled with what is lexically close to its seed.

    ``transcripts(video_id bigint, transcript)``. Returns one row per piece: ``(video_id, row, start, length, ids_crc32, tokens,
    window_id, offset)``, all bigint; ``row`` tells rows of equal id apart, ``start`` counts the transcript's ids before the piece,
    ``tokens`` all of them, the end mark included.

    Full windows of a transcript are windows of their own. The remainders are sorted by their smallest token-pair hash, so that
    texts with much in common are in one shard; a shard holds about ``capacity`` tokens. Each has an inverted BM25 index with the
    idf and average length of the whole token sequences of all transcripts, which returns the unused neighbours of the longest unused remainder; these fill its window by
    score and the last is cut to fit, so only the last window of a shard is short. A shard is bounded and the sort key ends in the row's
    number, so copies and hot sources are spread like anything else.

    NULL and empty transcripts are the end mark alone. Repeated rows are packed each. An empty table gives no rows.
    """
    spark = transcripts.sparkSession
    path = vocabulary or vocabulary_file()
    rows = transcripts.select(F.col("video_id").cast("bigint").alias("video_id"), "transcript", F.monotonically_increasing_id().alias("row"))
    encoded = cut_lineage(rows.mapInArrow(_encoded(path, window), "video_id bigint, row bigint, tokens bigint, crcs array<bigint>, ids binary, near bigint, found binary"))
    remainders = encoded.filter(F.octet_length("ids") > 0)
    statistics = spark.sparkContext.broadcast(corpus_statistics(encoded))
    total = remainders.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = -(-total // (8 * capacity)) or 1  # two shards a task, four bytes a token
    sharded = remainders.select("video_id", "row", "tokens", "ids", "near").repartitionByRange(parts, F.col("near"), F.col("row")).sortWithinPartitions(
        "near", "row").withColumn("part", F.spark_partition_id().cast("bigint"))
    pieces = cut_lineage(sharded.mapInArrow(_packed(statistics, window, capacity),
                         "video_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, tokens bigint, part bigint, window bigint, offset bigint"))
    fulls = encoded.filter(F.size("crcs") > 0).select("video_id", "row", "tokens", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "video_id", "row", (F.col("k") * window).cast("bigint").alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32", "tokens",
        F.monotonically_increasing_id().alias("window_id"), F.lit(0).cast("bigint").alias("offset"))
    # Windows of remainders are numbered below zero, by part and place, so the two kinds can't meet.
    mixed_windows = pieces.select("video_id", "row", "start", "length", "ids_crc32", "tokens",
                                  (-(F.col("part") * F.lit(1 << 33) + F.col("window")) - 1).alias("window_id"), "offset")
    return fulls.union(mixed_windows)

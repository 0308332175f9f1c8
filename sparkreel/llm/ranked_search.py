"""Ranked search of transcripts: range-maximum tables per posting list, best-first over document intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from sparkreel.llm.shingles import text_buffer, text_slices, word_spans
from sparkreel.session import cut_lineage

#: Bytes that no term holds: ASCII without letters and digits.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Searches of one pass; their terms' weights are all that is sent to the tasks.
SEARCHES = 1024
#: A block of documents ends at so many documents or postings.
DOCS, POSTINGS = 4096, 1 << 20
#: Intervals handled at once.
WIDTH = 512
SCALE = 1_000_000_000
NONE = np.int64(-1)


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of each text (A-Z lower-cased), one text after the other, and the number of terms before each text."""
    raw, offsets = text_buffer(column)
    hashes, _, _, before = word_spans(raw, offsets, BETWEEN)
    return hashes, before


@dataclass
class Searches:
    """The searches of one pass: distinct terms, and of each search the terms (their places) and how often each is named."""
    hashes: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def _searches(texts: list[str | None]) -> Searches:
    hashes, before = term_hashes(pa.array(texts, pa.string()))
    distinct = np.unique(hashes)
    places = np.searchsorted(distinct, hashes)
    own = [np.unique(places[a:b], return_counts=True) for a, b in zip(before, before[1:])]
    return Searches(distinct, [t for t, _ in own], [n for _, n in own])


def _nested(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _indexed(hashes: np.ndarray):
    """Blocks of documents, ascending by id (NULL last), with the posting lists of the given terms."""
    def block(ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        names, sizes = np.unique(term, return_counts=True)
        lists = pa.StructArray.from_arrays([pa.array(names, pa.int32()), _nested(doc, sizes), _nested(tf, sizes)], ["term", "docs", "tfs"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([one(ids.take(pa.array(order))), one(pa.array(lengths[order], pa.int64())), one(lists)], ["ids", "lengths", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings = [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            return block(ids, *[np.concatenate([x[k] for x in held]) for k in range(1, 5)])

        for batch in text_slices(batches, "transcript"):
            found, before = term_hashes(batch.column("transcript"))
            lengths = np.diff(before)
            place = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
            hit = hashes[place] == found if len(hashes) else np.zeros(len(found), bool)
            doc = np.repeat(np.arange(len(lengths)), lengths)[hit]
            pairs, tf = np.unique(doc * max(len(hashes), 1) + place[hit], return_counts=True)
            doc, term = np.divmod(pairs, max(len(hashes), 1))
            held.append((batch.column("video_id"), lengths, doc + docs, term, tf))
            docs, postings = docs + len(lengths), postings + len(pairs)
            if docs >= DOCS or postings >= POSTINGS:
                yield flush()
                held, docs, postings = [], 0, 0
        if held:
            yield flush()
    return run


class _Block:
    """One block's posting lists with their impacts: range-maximum sparse tables and ranks of documents, all lists end to end."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        self.row = np.full(n_terms, len(terms), np.int64)
        self.row[terms] = np.arange(len(terms))
        self.start = np.concatenate([np.cumsum(sizes) - sizes, [len(docs)]])
        # Postings of each list before each document; the last row is that of a term the block lacks.
        held = np.zeros((len(terms) + 1, n_docs + 1), np.int32)
        held[np.repeat(np.arange(len(terms)), sizes), docs + 1] = 1
        self.before = np.cumsum(held, axis=1, dtype=np.int32)
        self.docs = docs
        best, at = [impacts], [np.arange(len(docs), dtype=np.int32)]
        step = 1
        while 2 * step <= (sizes.max() if len(sizes) else 0):
            a, b = best[-1][:-step], best[-1][step:]
            right = b > a
            pad = np.full(step, NONE)
            best.append(np.concatenate([np.where(right, b, a), pad]))
            at.append(np.concatenate([np.where(right, at[-1][step:], at[-1][:-step]), np.zeros(step, np.int32)]))
            step *= 2
        self.best, self.at = np.array(best), np.array(at)

    def maxima(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest impact of postings [first, stop) and where it stands; 0 and any place where there are none."""
        size = stop - first
        some = size > 0
        level = np.where(some, np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, 0)
        left = np.where(some, first, 0)
        right = np.where(some, stop - (1 << level), 0)
        a, b = self.best[level, left], self.best[level, right]
        return np.where(some, np.maximum(a, b), 0), np.where(b > a, self.at[level, right], self.at[level, left])

    def search(self, terms: np.ndarray, repeats: np.ndarray, limit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``limit`` best documents (places, scores) with at least the score ``least``; of equal scores those that come first.

        Every interval of documents left is bounded by the sum of its lists' maxima. The intervals of the greatest bounds are
        split at the document of the list maximum that counts most there; it is scored, and intervals below the score to beat go, as do
        those that could only tie with it and come later.
        """
        row = self.row[terms]
        named = row < len(self.before) - 1
        row, repeats = row[named], repeats[named].astype(np.int64)
        if not len(row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = self.start[row]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.zeros(1, np.int64), np.full(1, self.n_docs, np.int64)

        def bounded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            most, at = self.maxima(start + self.before[row, low[:, None]], start + self.before[row, high[:, None]])
            most = most * repeats
            lead = most.argmax(axis=1)
            return most.sum(axis=1), self.docs[at[np.arange(len(low)), lead]]

        bound, split = bounded(low, high)
        while True:
            beat = scores[-1] if len(scores) == limit else least
            after = found[-1] if len(scores) == limit else self.n_docs
            open_ = (bound > beat) | ((bound == beat) & (low < after))
            low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
            if not len(low):
                return found, scores
            if len(low) > WIDTH:
                best = np.argpartition(-bound, WIDTH)
                now, later = best[:WIDTH], best[WIDTH:]
            else:
                now, later = np.arange(len(low)), np.zeros(0, np.int64)
            doc = split[now]
            first = self.before[row, doc[:, None]]
            holds = self.before[row, doc[:, None] + 1] > first
            own = np.where(holds, self.best[0][np.where(holds, start + first, 0)], 0) @ repeats
            found, scores = np.concatenate([found, doc]), np.concatenate([scores, own])
            top = np.lexsort((found, -scores))[:limit]
            top = top[scores[top] >= least]
            found, scores = found[top], scores[top]
            a, b = np.concatenate([low[now], doc + 1]), np.concatenate([doc, high[now]])
            some = a < b
            a, b = a[some], b[some]
            fresh = bounded(a, b) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            low, high = np.concatenate([low[later], a]), np.concatenate([high[later], b])
            bound, split = np.concatenate([bound[later], fresh[0]]), np.concatenate([split[later], fresh[1]])


def _found(searches: Searches, weights: np.ndarray, docs: int, tokens: int, limit: int):
    """The best documents of each search in all blocks of a task; what was found in one block is what the next must beat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[list, list]] = [([], []) for _ in searches.terms]
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                lengths = batch.column("lengths")[i].values.to_numpy()
                lists = batch.column("lists")[i].values
                terms = lists.field("term").to_numpy()
                places, tf = (lists.field(c).flatten().to_numpy().astype(np.int64) for c in ("docs", "tfs"))
                sizes = pc.list_value_length(lists.field("docs")).to_numpy(zero_copy_only=False).astype(np.int64)
                m = 75 + 25 * lengths * docs // max(tokens, 1)
                impacts = np.repeat(weights[terms], sizes) * (SCALE * tf // (1000 * tf + 12 * m[places]))
                block = _Block(terms, sizes, places, impacts, len(ids), len(weights))
                for s, (held, points) in enumerate(best):
                    least = min(points) if len(points) == limit else 1
                    at, score = block.search(searches.terms[s], searches.repeats[s], limit, least)
                    if len(at):
                        held += ids.take(pa.array(at)).to_pylist()
                        points += score.tolist()
                        order = sorted(range(len(held)), key=lambda k: (-points[k], held[k] is None, held[k] or type(held[k])()))[:limit]
                        best[s] = ([held[k] for k in order], [points[k] for k in order])
        if kind is not None:
            sizes = [len(h) for h, _ in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array([x for h, _ in best for x in h], kind),
                 pa.array([x for _, p in best for x in p], pa.int64())], ["search", "video_id", "score"])
    return run


def rank_transcripts(transcripts: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` best transcripts for each query text, over all transcripts.

    ``transcripts(video_id, transcript)``, ``queries(clip_id, text)``: texts of clips, say their titles, that are looked for. A term is a
    run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. With N transcripts that hold terms, L terms in all, and df
    of them holding a term, its weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); a transcript of n terms, tf of them that term, scores
    w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, summed over the query's terms, repeats included. Returns ``(clip_id,
    rank int, video_id, score bigint)`` for scores above 0, equal scores by ascending video_id.

    The index holds, per block of documents, the posting lists of the terms that the queries name. Within a block a search is
    best-first over intervals of documents: a sparse table over each list gives the greatest impact in any interval, the sum over the
    lists bounds it, and intervals are split at documents of greatest impact until none left can enter the best. Nothing is capped:
    whatever could still enter is opened. Terms are told apart by 64-bit hashes.

    Queries are taken ``SEARCHES`` at a time, so that what a pass sends to its tasks stays bounded however many there are. Each row of
    ``queries`` is a search of its own, also with a NULL or repeated clip_id. NULL and empty texts hold no term: such queries find
    nothing, such transcripts are never found. A NULL video_id comes after all others; of rows with one video_id each is ranked.
    """
    rows = transcripts.select("video_id", "transcript")
    id_field = rows.schema["video_id"]
    spark = rows.sparkSession
    asked = cut_lineage(queries.select("clip_id", "text").withColumn("_n", F.monotonically_increasing_id()))
    passes = -(-asked.count() // SEARCHES)
    asked = asked.withColumn("_pass", F.pmod(F.xxhash64("_n"), F.lit(max(passes, 1))))
    index_type = f"ids array<{id_field.dataType.simpleString()}>, lengths array<bigint>, lists array<struct<term: int, docs: array<int>, tfs: array<int>>>"
    out = None
    for number in range(max(passes, 1)):
        named = asked.filter(F.col("_pass") == number).orderBy("_n").collect()
        searches = _searches([r.text for r in named])
        index = cut_lineage(rows.mapInArrow(_indexed(searches.hashes), index_type))
        facts = index.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("docs"),
                          F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("tokens")).first()
        holding = index.select(F.explode("lists").alias("x")).groupBy("x.term").agg(F.sum(F.size("x.docs")).alias("df")).collect()
        docs, tokens = facts.docs or 0, facts.tokens or 0
        weights = np.zeros(len(searches.hashes), np.int64)
        for term, df in holding:
            weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
        kind = StructType([*spark.createDataFrame([], "search int").schema, StructField("video_id", id_field.dataType), *spark.createDataFrame([], "score bigint").schema])
        found = index.mapInArrow(_found(searches, weights, docs, tokens, limit), kind)
        best = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), F.col("video_id").asc_nulls_last()))
        ranked = found.withColumn("rank", best).filter(F.col("rank") <= limit)
        names = spark.createDataFrame([(k, r._n) for k, r in enumerate(named)], "search int, _n bigint")
        ranked = ranked.join(names, "search").select("_n", "rank", "video_id", "score")
        out = ranked if out is None else out.union(ranked)
    return asked.select("clip_id", "_n").join(out, "_n").select("clip_id", "rank", "video_id", "score")

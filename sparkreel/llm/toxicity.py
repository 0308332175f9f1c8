"""Toxicity of transcripts: class-conditional Kneser-Ney models of words' characters, compared passage by passage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkreel.llm.repeated_text import Packing
from sparkreel.llm.shingles import LOWER, PIECE, span_hashes, text_buffer, text_slices, word_spans
from sparkreel.session import cut_lineage, new_folder, remove_folder, written

#: A symbol is predicted from the up to five before it in its word.
ORDER = 6
#: So many of the commonest words are sent to all tasks with their ratios; the others are joined.
COMMON = 1 << 19
#: So many of the commonest n-grams of words are sent to all tasks with their log-ratios; the others are joined.
COMMON_GRAMS = 1 << 18
#: Bytes of words whose n-grams are made at once.
GATHERED = 1 << 19
DISCOUNT = 0.75
#: Lengths, in words, of the passages whose mean log-ratios are compared.
PASSAGES = (1, 2, 4, 8, 16, 32)
BEST_WORDS = 4
#: Features of a text.
WIDTH = len(PASSAGES) + BEST_WORDS + 2

#: Low bits of a log-ratio that are summed apart.
UNITS = 20

#: Bytes that don't belong to words: ASCII other than letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
OPEN, CLOSE = 1, 2


def _unique_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Per word of the texts the number of its spelling; words before each text; the spellings; their hashes."""
    raw, offsets = text_buffer(column)
    hashes, starts, stops, before = word_spans(raw, offsets, APART)
    unique, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    lower = LOWER[raw].tobytes()
    spellings = [lower[a:b] for a, b in zip(starts[example].tolist(), stops[example].tolist(), strict=True)]
    return which, before, spellings, unique.view(np.int64)


def _grams(spellings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each predicted symbol of each word: the word's number, how long an n-gram ends there (at most ORDER), and by order
    (rows 1 to ORDER) the n-gram itself: its bytes as one number, below its order."""
    symbols = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in spellings), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in spellings], np.int64)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(symbols))
    at = place[place > begin]
    word = np.repeat(np.arange(len(spellings)), sizes)[at]
    longest = np.minimum(at - begin[at] + 1, ORDER)
    grams, body = np.zeros((ORDER + 1, len(at)), np.int64), np.zeros(len(at), np.int64)
    for n in range(1, ORDER + 1):
        body = body | symbols[np.maximum(at - n + 1, 0)] << 8 * (n - 1)
        grams[n] = body | n << 48
    return word, longest, grams


def _packed(rows: DataFrame, words: bytes) -> DataFrame:
    """``rows`` with ``packed`` instead of their transcripts, for the way to where they are joined; ``_unpacked`` undoes it."""
    names = [c for c in rows.columns if c != "transcript"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packing(words).pack
        for batch in text_slices(batches, "transcript"):
            packed = [None if t is None else pack(t) for t in batch.column("transcript").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(packed, pa.binary())], [*names, "packed"])

    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("packed", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _unpacked(batches: Iterator[pa.RecordBatch], words: bytes) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with their transcripts again."""
    plain = Packing(words).plain
    for batch in text_slices(batches, "packed", PIECE // 4):
        names = [c for c in batch.schema.names if c != "packed"]
        texts = pa.array([None if x is None else plain(x) for x in batch.column("packed").to_pylist()], pa.binary()).cast(pa.string())
        yield from text_slices([pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], texts], [*names, "transcript"])], "transcript")


def _sample(transcripts: DataFrame) -> bytes:
    """A few texts whose words help to pack the others; results don't depend on them."""
    return "".join(r[0] or "" for r in transcripts.select(F.substring("transcript", 1, 4096)).limit(32).collect()).encode()


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, toxic, plain): how often each word stands in all transcripts and in those labelled either way."""
    for batch in batches:
        which, before, spellings, _ = _unique_words(batch.column("transcript"))
        label = np.repeat(batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False), np.diff(before))
        counts = [np.bincount(which[own], minlength=len(spellings)) for own in (slice(None), label == 1, label == 0)]
        yield pa.RecordBatch.from_arrays([pa.array(spellings, pa.binary()), *map(pa.array, counts)], ["word", "n", "toxic", "plain"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words with the hashes they have in a text."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        stops = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), stops[:-1]])[:len(stops)]
        hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), starts, stops)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *batch.columns], ["hash", *batch.schema.names])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, brought together while their words are few bytes: an n-gram of many words is sent on once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("word").nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of distinct words, from order 2 on; counts only where the n-gram is the longest at its place."""
    for batch in _gathered(batches):
        word, longest, grams = _grams(batch.column("word").to_pylist())
        weights = [batch.column(c).to_numpy(zero_copy_only=False)[word] for c in ("toxic", "plain")]
        for n in range(2, ORDER + 1):
            there = longest >= n
            found, which = np.unique(grams[n][there], return_inverse=True)
            top = (longest == n)[there]
            sums = [np.bincount(which, np.where(top, w[there], 0), len(found)).astype(np.int64) for w in weights]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (found, *sums))], ["gram", "toxic", "plain"])


def _backed_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams that the longest ones of the words back off to, each once a batch."""
    for batch in _gathered(batches):
        _, longest, grams = _grams(batch.column("word").to_pylist())
        for n in range(1, ORDER):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(grams[n][longest > n]))], ["gram"])


def _longest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The word's number and the longest n-gram of each place of each word."""
    word, longest, grams = _grams(batch.column("word").to_pylist())
    return word, grams[longest, np.arange(len(word))]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest n-grams of the words' places and how often they are that."""
    for batch in _gathered(batches):
        found, times = np.unique(_longest(batch)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["gram", "times"])


# SQL: an n-gram's order, its context (the last symbol blanked) and what it backs off to (without the first symbol).
N = "int(shiftright(gram, 48))"
CONTEXT = "gram & ~255L"
TAIL = f"shiftleft(bigint({N} - 1), 48) | (gram & (shiftleft(1L, 8 * ({N} - 1)) - 1))"


@dataclass
class Model:
    """Counts of n-grams by key, ratios of the words they were counted in, and the weights of the calibrated comparison.

    ``grams(gram, toxic, plain)`` holds every n-gram of order 2 and more and, where it was the longest at its place, its counts by
    class; the sums by context and the continuations all lower orders rest on follow from it. ``ratios(hash, ratio)`` holds the words of the
    transcripts the model was fitted on; ``common`` are the hashes and ratios of the commonest, ``all_common`` says whether these are all.
    Both tables are files of the shared folder.
    """
    grams: DataFrame
    ratios: DataFrame | None = None
    common: tuple[np.ndarray, np.ndarray] | None = None
    all_common: bool = False
    means: np.ndarray | None = None
    spreads: np.ndarray | None = None
    weights: np.ndarray | None = None


def word_ratios(words: DataFrame, model: Model) -> DataFrame:
    """(hash, ratio) of ``words(hash, word)``: ln P(word | toxic) - ln P(word | ordinary), per symbol.

    With ``p0 = 1/256``, the shared estimate of order n is ``base + slope * p(n-1)`` of the n-gram without its first symbol; the longest
    n-gram at a place is estimated by class and backs off to it. A context has at most 256 n-grams, so no key of these joins is hot but
    those of the first orders, which are few.
    """
    spark = words.sparkSession
    folder = new_folder(spark, "word-ratios")
    tails = model.grams.groupBy(F.expr(TAIL).alias("gram")).agg(F.count("*").alias("follow"))
    tail_contexts = tails.groupBy(F.expr(CONTEXT).alias("context")).agg(F.sum("follow").alias("follow_sum"), F.count("*").alias("follow_kinds"))
    lower = words.select("word").mapInArrow(_backed_off, "gram bigint").distinct()
    seen = lower.join(tails, "gram", "left").withColumn("context", F.expr(CONTEXT)).join(tail_contexts, "context", "left")
    total = F.coalesce("follow_sum", F.lit(0))
    shares = written(seen.select(
        "gram", F.when(total > 0, F.greatest(F.coalesce("follow", F.lit(0)) - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0).alias("base"),
        F.when(total > 0, DISCOUNT * F.col("follow_kinds") / total).otherwise(1.0).alias("slope")), f"{folder}/shares")
    level = shares.filter(f"{N} = 1").select("gram", (F.col("base") + F.col("slope") / 256).alias("p"))
    levels = level
    for n in range(2, ORDER):
        below = level.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
        level = shares.filter(f"{N} = {n}").withColumn("tail", F.expr(TAIL)).join(below, "tail").select(
            "gram", (F.col("base") + F.col("slope") * F.col("below")).alias("p"))
        # All but the last order are used twice; written, they cut the chain.
        level = written(level, f"{folder}/level-{n}") if n < ORDER - 1 else level
        levels = levels.unionByName(level)

    contexts = model.grams.groupBy(F.expr(CONTEXT).alias("context")).agg(
        *[F.sum(k).alias(f"{k}_sum") for k in ("toxic", "plain")], *[F.count_if(F.col(k) > 0).alias(f"{k}_kinds") for k in ("toxic", "plain")])
    longest = words.select("word").mapInArrow(_ends, "gram bigint, times bigint").groupBy("gram").agg(F.sum("times").alias("times")).withColumns(
        {"context": F.expr(CONTEXT), "tail": F.expr(TAIL)})
    known = longest.join(model.grams, "gram", "left").join(contexts, "context", "left").join(
        levels.select(F.col("gram").alias("tail"), F.col("p").alias("behind")), "tail")

    def chance(kind: str):
        total = F.coalesce(f"{kind}_sum", F.lit(0))
        own = F.greatest(F.coalesce(kind, F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{kind}_kinds") * F.col("behind")
        return F.when(total > 0, own / total).otherwise(F.col("behind"))

    # Whole units of 1e-12: their sums don't depend on the order of the rows.
    log_ratio = (F.log(chance("toxic")) - F.log(chance("plain"))).cast("decimal(18,12)")
    logs = written(known.select("gram", "times", (log_ratio * F.lit(Decimal(10 ** 12))).cast("bigint").alias("units")), f"{folder}/logs")
    # An n-gram that is not among the commonest stands in few words, so no key of the join is hot.
    often = _frequent(logs, "times", COMMON_GRAMS)
    shared = spark.sparkContext.broadcast(_listed(logs.filter(F.col("times") >= often), "gram", "units"))

    def of_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            word, own = _longest(batch)
            at, there = _found(shared.value[0], own)
            units, word = shared.value[1][at[there]], word[there]
            # In two parts, so that no word is too long for its sum.
            sums = [np.bincount(word, part, batch.num_rows).astype(np.int64) for part in (units >> UNITS, units & ((1 << UNITS) - 1))]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), *map(pa.array, (*sums, np.bincount(word, minlength=batch.num_rows)))],
                                             ["hash", "high", "low", "n"])

    def of_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            word, own = _longest(batch)
            absent = ~_found(shared.value[0], own)[1]
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[word[absent]]), pa.array(own[absent])], ["hash", "gram"])

    named = words.select("hash", "word")
    many = named.mapInArrow(of_others, "hash bigint, gram bigint").join(logs.filter(F.col("times") < often), "gram").select(
        "hash", F.expr(f"shiftright(units, {UNITS})").alias("high"), F.expr(f"units & {(1 << UNITS) - 1}L").alias("low"), F.lit(1).cast("bigint").alias("n"))
    sums = named.mapInArrow(of_common, "hash bigint, high bigint, low bigint, n bigint").unionByName(many).groupBy("hash").agg(
        *[F.sum(c).alias(c) for c in ("high", "low", "n")])
    units = (F.col("high").cast("decimal(17,0)") * F.lit(1 << UNITS) + F.col("low")).cast("decimal(25,0)")
    ratios = written(sums.select("hash", ((units * F.lit(Decimal("1E-12"))).cast("double") / F.col("n")).alias("ratio")), f"{folder}/ratios")
    for part in ("shares", *[f"level-{n}" for n in range(2, ORDER - 1)], "logs"):
        remove_folder(f"{folder}/{part}")
    return ratios


def _frequent(rows: DataFrame, times: str, most: int) -> int:
    """The least number of times, 0 for all, that at most ``most`` of the rows reach. At most 65,536 rows reach the driver."""
    if rows.count() <= most:
        return 0
    sizes = dict(rows.groupBy(F.least(times, F.lit(1 << 16)).alias("times")).count().collect())
    room, least = most, 1 << 62
    for n in sorted(sizes, reverse=True):
        if sizes[n] > room:
            break
        room, least = room - sizes[n], n
    return least


def _listed(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of few rows, in the order of the first."""
    listed = rows.select(key, value).toArrow()
    keys, values = (listed.column(c).to_numpy() for c in (key, value))
    order = np.argsort(keys)
    return keys[order], values[order]


def _found(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes stand in the sorted ``known``, and whether they do."""
    at = np.searchsorted(known, hashes)
    there = at < len(known)
    there[there] = known[at[there]] == hashes[there]
    return at, there


def _features(column: pa.Array, common: tuple[np.ndarray, np.ndarray], rare: pa.Array | None = None) -> np.ndarray:
    """Per text: the best passage of each length, the best words, the mean of all words, and the number of words (log).

    ``rare`` lists for each text the (hash, ratio) of its words that are not common, and maybe others."""
    which, before, _, hashes = _unique_words(column)
    at, there = _found(common[0], hashes)
    own = np.zeros(len(hashes))
    own[there] = common[1][at[there]]
    if rare is not None:
        known, given = (rare.flatten().field(c).to_numpy() for c in ("hash", "ratio"))
        at, there = _found(hashes.view(np.uint64), known.view(np.uint64))
        own[at[there]] = given[there]
    ratios = own[which]
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    out = np.zeros((len(column), WIDTH))
    for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
        n = b - a
        if n:
            for k, size in enumerate(PASSAGES):
                size = min(size, n)
                out[i, k] = (sums[a + size:b + 1] - sums[a:b + 1 - size]).max() / size
            best = np.partition(ratios[a:b], max(0, n - BEST_WORDS))[-BEST_WORDS:]
            best = np.sort(best)[::-1]
            out[i, len(PASSAGES):len(PASSAGES) + len(best)] = best
            out[i, -2] = (sums[b] - sums[a]) / n
            out[i, -1] = np.log1p(n)
    return out


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``part(x, toxic)`` summed over all batches of ``rows(toxic, x)``. Only the sums reach the driver."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)
                sums = part(batch.column("x").flatten().to_numpy().reshape(len(y), WIDTH), y).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["place", "value"])

    # Decimals: their sums don't depend on the order of the rows. The few rows are sorted here.
    total = rows.mapInArrow(parts, "place int, value double").groupBy("place").agg(F.sum(F.col("value").cast("decimal(28,12)")).cast("double").alias("value"))
    return np.array([r["value"] for r in sorted(total.collect(), key=lambda r: r["place"])])


def _logistic(rows: DataFrame, means: np.ndarray, spreads: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression over all of ``rows(toxic, x)``, by Newton's method."""
    w = np.zeros(WIDTH + 1)
    penalty = np.diag([1e-3, *[ridge] * WIDTH])

    def slopes(w: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(x)), (x - means) / spreads])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.vstack([(x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p)])
        return part

    for _ in range(rounds):
        sums = _summed(rows, slopes(w)).reshape(WIDTH + 2, WIDTH + 1)
        step = np.linalg.solve(sums[:-1] + penalty, sums[-1] - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _rare_words(rows: DataFrame, model: Model, fitted: bool) -> DataFrame:
    """(row, rare): the words of each row that are not common, with their ratios. Those of the rows that the model was fitted on are in
    its table."""
    shared = rows.sparkSession.sparkContext.broadcast(model.common)

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "transcript"):
            which, before, spellings, hashes = _unique_words(batch.column("transcript"))
            absent = ~_found(shared.value[0], hashes)[1]
            text = np.repeat(np.arange(len(batch)), np.diff(before))[absent[which]]
            pairs = np.unique(np.column_stack([text, which[absent[which]]]), axis=0)
            words = [] if fitted else [pa.array([spellings[k] for k in pairs[:, 1].tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(pairs[:, 0])), pa.array(hashes[pairs[:, 1]]), *words],
                                             ["row", "hash", "word"][:2 + len(words)])

    found = rows.select("row", "transcript").mapInArrow(missing, "row bigint, hash bigint" + ("" if fitted else ", word binary"))
    if fitted:
        ratios = model.ratios
    else:
        found = cut_lineage(found.distinct())
        ratios = word_ratios(found.select("hash", "word").distinct(), model)
    # Sets: equal rows name the same words.
    return found.select("row", "hash").join(ratios, "hash").groupBy("row").agg(F.collect_set(F.struct("hash", "ratio")).alias("rare"))


def _described(rows: DataFrame, model: Model, fitted: bool, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows`` and the features ``x array<double>`` of their transcripts."""
    rows = rows.select(*keep, *[c for c in ("transcript",) if c not in keep])
    fields, joined, words = rows.schema, not (fitted and model.all_common), b""
    if joined:
        # Equal rows share their number: they hold the same words. Should others share it, each is told the words of both, which changes nothing.
        words = _sample(rows)
        ids = rows.withColumn("row", F.xxhash64(*[F.col(c) for c in rows.columns]))
        rows = _packed(ids, words).join(_rare_words(ids, model, fitted), "row", "left").drop("row")
    shared = rows.sparkSession.sparkContext.broadcast(model.common)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches, words) if joined else text_slices(batches, "transcript"):
            x = _features(batch.column("transcript"), shared.value, batch.column("rare") if joined else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "x"])

    schema = T.StructType([*[fields[c] for c in keep], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(described, schema)


def fit(transcripts: DataFrame, feedback: DataFrame, sample: int | None = None, common: int = COMMON, seed: int = 5) -> Model:
    """Learn from ``feedback(video_id, toxic)`` what sets toxic transcripts apart.

    One labelled row in four calibrates the comparison, all others are counted for the language models, whatever their number; a caller
    may ask for at most ``sample`` calibrating rows (smallest hash first). The highest order is counted by class; all
    lower orders are continuation counts over the words of all transcripts, labelled or not, so rare and unseen expressions fall back
    on the same counts. Words have their ratios in a table; ``common`` bounds those that are sent to all tasks. Without labels of both
    classes nothing can be learnt, and all scores are 0.
    """
    rank = F.xxhash64("video_id", F.lit(seed))
    labels = feedback.select("video_id", "toxic").dropna().groupBy("video_id").agg(F.max("toxic").cast("int").alias("toxic"))
    quarter = F.pmod(rank, F.lit(4)) == 0
    calibrating = labels.filter(quarter)
    calibrating = cut_lineage(calibrating if sample is None else calibrating.orderBy(rank, "video_id").limit(sample))
    counted = labels.join(calibrating.select("video_id"), "video_id", "left_anti")

    texts = transcripts.select("video_id", "transcript")
    sample_words, folder = _sample(texts), new_folder(transcripts.sparkSession, "toxicity")
    schema = "word binary, n bigint, toxic bigint, plain bigint"
    # Texts of the quarter have no counted label, unless a sample leaves some of it.
    asked = texts.filter(~quarter) if sample is None else texts
    spelled = _packed(asked, sample_words).join(counted, "video_id", "left").select("packed", "toxic").mapInArrow(
        lambda batches: _spelled(_unpacked(batches, sample_words)), schema)
    if sample is None:
        others = texts.filter(quarter).select("transcript", F.lit(None).cast("int").alias("toxic"))
        spelled = spelled.unionByName(others.mapInArrow(lambda batches: _spelled(text_slices(batches, "transcript")), schema))
    words = written(spelled.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "plain")]).mapInArrow(
        _hashed, "hash bigint, word binary, n bigint, toxic bigint, plain bigint"), f"{folder}/words")
    model = Model(written(words.mapInArrow(_counted, "gram bigint, toxic bigint, plain bigint").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), f"{folder}/grams"))
    model.ratios = word_ratios(words.select("hash", "word"), model)
    often = _frequent(words, "n", common)
    model.all_common = often == 0
    chosen = model.ratios if model.all_common else model.ratios.join(words.filter(F.col("n") >= often).select("hash"), "hash", "left_semi")
    model.common = _listed(chosen, "hash", "ratio")
    remove_folder(f"{folder}/words")

    # Texts that can't calibrate go before the join, which may shuffle the rest.
    held = _packed(texts.filter(quarter), sample_words).join(calibrating, "video_id").select("toxic", "packed")
    held = written(held.mapInArrow(lambda batches: _unpacked(batches, sample_words), "toxic int, transcript string"), f"{folder}/held")
    seen = cut_lineage(_described(held, model, True, ["toxic"]))
    remove_folder(f"{folder}/held")
    n, toxic = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model.means, model.spreads, model.weights = np.zeros(WIDTH), np.ones(WIDTH), np.array([-30.0] + [0.0] * WIDTH)
    if 0 < toxic < n:
        means = _summed(seen, lambda x, y: x.sum(axis=0)) / n
        model.means, model.spreads = means, np.maximum(np.sqrt(_summed(seen, lambda x, y: ((x - means) ** 2).sum(axis=0)) / n), 1e-9)
        model.weights = _logistic(seen, model.means, model.spreads)
    return model


def score_toxicity(transcripts: DataFrame, model: Model, fitted: bool = False) -> DataFrame:
    """Score every whole transcript between 0 and 1; higher means likelier toxic.

    ``transcripts(video_id, transcript)``. Returns ``(video_id, transcript, score double)``, one row per row. A word's log-ratio is its
    log-likelihood under the toxic model less that under the ordinary one, divided by its length. Means over passages of 1 to 32
    words, the best words and the mean of the whole text are compared by a calibrated logistic. Only the text enters the score. Words
    that are not among the model's common ones get their ratios by joins; ``fitted`` says that the model was fitted on these
    transcripts, so that there are none where all of its words are common. NULL and empty transcripts count as a text of no words;
    repeated rows get equal scores; other columns are not carried.
    """
    x = F.transform(F.arrays_zip("x", F.lit(model.means.tolist()).alias("mean"), F.lit(model.spreads.tolist()).alias("spread"),
                                 F.lit(model.weights[1:].tolist()).alias("weight")), lambda c: (c["x"] - c["mean"]) / c["spread"] * c["weight"])
    total = F.aggregate(x, F.lit(float(model.weights[0])), lambda a, c: a + c)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    return _described(transcripts, model, fitted, ["video_id", "transcript"]).select("video_id", "transcript", score.alias("score"))

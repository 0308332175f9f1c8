"""Held-out test items inside transcripts: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.llm.records import let
from sparkreel.session import cut_lineage

#: Tables of up to this many narrow rows (some 32 MB) are broadcast; larger ones are joined by a shuffle.
SMALL = 1_000_000


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(words: Column, length: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - length, F.lit(0)))


def _sketch_rank(shingle_hash: Column) -> Column:
    """The place of a shingle in the one random order that all MinHash sketches share."""
    return F.xxhash64(shingle_hash, F.lit(1))


def _if_small(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and counted, with a broadcast hint if it is small enough."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def contaminated(transcripts: DataFrame, held_out: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Transcripts that hold at least ``percent`` in a hundred of a held-out item's word shingles.

    ``transcripts(video_id, transcript)``, ``held_out(clip_id, text)``. Returns ``(video_id, clip_id, n_shingles, n_shared, containment)``,
    one row per pair, the largest share if an id stands for several texts.

    Items are partitioned by size into classes of a power of two. An item's sketch holds its k smallest shingles under one random
    order, k being one more than what an item of its class may lack; so a transcript with the required share holds at least one of
    them, and no pair is missed. Transcripts are hashed once, each shingle meets the sketches of the classes that fit into the
    transcript, and transcripts with a hit are cut into shingles again, as text, and joined with the items' shingles for the exact
    share. Equal items are searched once. The sketches and the ids of transcripts with hits are broadcast only if counted to be
    small, else shuffled by shingle or id.

    Words are lower-cased runs of letters and digits. Texts of fewer than ``words`` words have one shingle, the whole sequence, so
    such items are found only in transcripts that are this sequence. NULL texts and texts without words neither hold nor are held. A
    NULL video_id or clip_id is a value like any other; repeated rows give one pair.
    """
    cut_up = lambda text: let(word_list(text), lambda w: F.array_distinct(F.transform(
        F.when(F.size(w) > 0, _starts(w, words)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(words)), " "))))
    items = held_out.select("clip_id", cut_up(F.col("text")).alias("shingles")).filter("shingles IS NOT NULL").withColumn("item", F.sha2(F.array_join("shingles", "\n").cast("binary"), 256))
    distinct = items.groupBy("item").agg(F.first("shingles").alias("shingles")).select(
        "item", "shingles", F.size("shingles").alias("n_shingles"), F.floor(F.log2(F.size("shingles"))).cast("int").alias("size_class"))
    # Of n shingles, n * (100 - percent) / 100 may be lacking; 2 ** (class + 1) is above every n of the class.
    keep = F.floor(F.pow(F.lit(2.0), F.col("size_class") + 1) * (100 - percent) / 100).cast("int") + 1
    hashed = lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(words)])
    ranked = F.array_sort(F.transform("shingles", lambda s: F.struct(_sketch_rank(hashed(s)).alias("rank"), hashed(s).alias("hash"))))
    sketches = _if_small(distinct.select(F.explode(F.slice(ranked, F.lit(1), keep)).alias("x"), "size_class").groupBy(
        F.col("x.hash").alias("hash")).agg(F.min("size_class").alias("least_class")))

    docs = transcripts.select("video_id", "transcript")
    hashes = let(word_list(F.col("transcript")), lambda w: F.transform(
        F.when(F.size(w) > 0, _starts(w, words)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)])))
    rows = docs.select("video_id", hashes.alias("hashes")).select("video_id", F.explode(F.array(F.struct("hashes", F.size("hashes").alias("places")))).alias("x"))
    rows = rows.select("video_id", "x.places", F.explode("x.hashes").alias("hash"))
    # A class fits if the share of its smallest item does; a transcript that holds it has as many places.
    fits = F.col("places") * 100 >= F.pow(F.lit(2.0), F.col("least_class")) * percent
    hits = rows.join(sketches, "hash").filter(fits).select(F.col("video_id").alias("hit")).distinct()
    hits = _if_small(hits)

    near = docs.join(hits, F.col("video_id").eqNullSafe(F.col("hit")), "left_semi")
    cut = near.select("video_id", F.xxhash64("transcript").alias("text"), F.explode(cut_up(F.col("transcript"))).alias("shingle"))
    wanted = _if_small(distinct.select("item", "n_shingles", F.explode("shingles").alias("shingle")))
    # Repeated rows would count a shingle twice.
    shared = cut.join(wanted, "shingle").groupBy("video_id", "text", "item", "n_shingles").agg(F.count_distinct("shingle").alias("n_shared"))
    found = shared.filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    found = found.groupBy("video_id", "item", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return found.join(items.select("clip_id", "item").distinct(), "item").select(
        "video_id", "clip_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), F.col("n_shared").cast("bigint").alias("n_shared"),
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))

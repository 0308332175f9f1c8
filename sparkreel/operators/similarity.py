"""Exact set-similarity matching without comparing all pairs.

Equal sets are collapsed to one class first, so any number of copies costs one row. Classes are then
matched through pairs of the rarest words of each set only (prefix filter): two sets above the threshold
must share two words among those. Pairs of words are far more than words, so what two sets of a small
vocabulary share by chance stays little. Wide sets have too many pairs; they meet through single words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkreel.functions.text import jaccard


def set_class(words: Column) -> Column:
    """Identity of a word set; NULL for the empty set, which resembles nothing."""
    return F.when(F.size(words) > 0, F.md5(F.array_join(F.array_sort(words), "\u0001")))


def classes_of(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """Distinct non-empty sets: (keys, class_id, words)."""
    rows = df.withColumn("class_id", set_class(F.col(words))).where("class_id IS NOT NULL")
    return rows.groupBy(*keys, "class_id").agg(F.any_value(words).alias("words"))


#: Sets of more words meet others through single words.
WIDE = 64


def _signatures(classes: DataFrame, counts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, class_id, len, double, sign): hashes of pairs (``double``) and of single words, among the rarest of each set.

    Of two sets that share ``n`` words, each has two shared ones among its ``len - n + 2`` rarest, and one among its ``len - n + 1``
    rarest. Single words are for pairs of sets one of which is wide, and for sets so small that one shared word may do.
    """
    tokens = classes.select(*keys, "class_id", F.size("words").alias("len"), F.explode("words").alias("word"))
    ranked = tokens.join(counts, "word").groupBy(*keys, "class_id", "len").agg(
        F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ordered"))
    # The small slack keeps a product such as 0.6 * 5 from rounding up past its integer.
    shared = F.ceil(F.col("len") * threshold - 1e-9)
    rarest = lambda n: F.transform(F.slice("ordered", F.lit(1), n.cast("int")), lambda x: x["word"])
    two = ranked.where(F.col("len") <= WIDE).select(*keys, "class_id", "len", F.lit(True).alias("double"), rarest(
        F.least("len", F.col("len") - F.greatest(shared, F.lit(2)) + 2)).alias("w")).withColumn("sign", F.explode(F.flatten(F.transform(
            "w", lambda x, i: F.transform(F.slice("w", i + 2, F.lit(WIDE)), lambda y: F.xxhash64(x, y)))))).drop("w")
    one = ranked.where((shared < 2) | (F.col("len") > WIDE * threshold)).select(*keys, "class_id", "len", F.lit(False).alias("double"), F.explode(
        rarest(F.least("len", F.col("len") - shared + 1))).alias("word")).withColumn("sign", F.xxhash64("word")).drop("word")
    return two.unionByName(one)


def similar_classes(left: DataFrame, right: DataFrame, threshold: float, keys: list[str] = []) -> DataFrame:
    """(keys, left_id, right_id, similarity) for set classes with Jaccard above ``threshold``."""
    both = left.select("words").unionByName(right.select("words"))
    counts = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    a = _signatures(left, counts, keys, threshold).withColumnsRenamed({"class_id": "left_id", "len": "left_len"})
    b = _signatures(right, counts, keys, threshold).withColumnsRenamed({"class_id": "right_id", "len": "right_len"})
    lengths = (F.col("left_len") >= F.col("right_len") * threshold) & (F.col("right_len") >= F.col("left_len") * threshold)
    longer = F.greatest("left_len", "right_len")
    meet = F.col("double") | (longer > WIDE) | (F.ceil(longer * threshold - 1e-9) < 2)
    pairs = a.join(b, [*keys, "double", "sign"]).where(lengths & meet).select(*keys, "left_id", "right_id").distinct()
    words = lambda df, side: df.select(*keys, F.col("class_id").alias(f"{side}_id"), F.col("words").alias(f"{side}_words"))
    full = pairs.join(words(left, "left"), [*keys, "left_id"]).join(words(right, "right"), [*keys, "right_id"])
    return full.withColumn("similarity", jaccard(F.col("left_words"), F.col("right_words"))).where(
        F.col("similarity") > threshold).drop("left_words", "right_words")

"""Connected components of a graph of links, without any task or the driver seeing a whole component."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from sparkreel.session import cut_lineage, new_folder, remove_folder, written


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: the smallest node reachable from each node that has a link.

    Each round gives every node the smallest label among itself and its neighbours and then the label of that label, so labels
    travel a distance that doubles; the rounds end when none changes. Each round is written to the shared folder.
    """
    folder = new_folder(links.sparkSession, "components")
    both = written(cut_lineage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()), f"{folder}/links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), f"{folder}/0")
    for step in count(1):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("next"))
        up = lower.select(F.col("node").alias("up"), F.col("next").alias("up_next"))
        jumped = written(lower.join(up, lower.next == up.up, "left").select(
            "node", "root", F.least("next", F.coalesce("up_next", "next")).alias("next")), f"{folder}/{step}")
        remove_folder(f"{folder}/{step - 1}")
        changed = not jumped.filter("root <> next").isEmpty()
        labels = jumped.select("node", F.col("next").alias("root"))
        if not changed:
            remove_folder(f"{folder}/links")
            return labels

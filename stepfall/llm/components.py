"""Connected components of a graph given by its edges, in shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.llm.scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges`` (columns ``a``, ``b``); ``comp`` is the smallest node reachable.

    Each round takes the smallest label among neighbours and then follows the
    label once (pointer jumping), until nothing changes. A hub's edges are reduced
    in the map tasks; only counts come to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.where("a <> b").distinct(), "edges")
    lowest = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = settle(lowest.select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).select("a", "comp")
        best = seen.unionByName(labels.select(F.col("node").alias("a"), "comp")).groupBy("a").agg(F.min("comp").alias("comp"))
        best = settle(best, "best")
        target = labels_of(best, "via", "to")
        jumped = best.join(target, F.col("comp") == F.col("via")).select(F.col("a").alias("node"), F.least("comp", "to").alias("comp"))
        jumped = settle(jumped, "labels")
        was = labels.select(F.col("node").alias("was_node"), F.col("comp").alias("was"))
        moved = jumped.join(was, F.col("node") == F.col("was_node")).where("comp <> was")
        labels = jumped
        if moved.isEmpty():
            return labels


def labels_of(best: DataFrame, node: str, comp: str) -> DataFrame:
    return best.select(F.col("a").alias(node), F.col("comp").alias(comp))

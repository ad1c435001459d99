"""Connected components of an edge table, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.session import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that can be
    reached, itself included. Nodes are longs; null nodes are not allowed.

    In each round every node joins its neighbour, or itself, of the smallest hash; the hash
    changes with the round, so the number of nodes falls by a factor whatever the order of
    the ids, also along chains. Neighbours are reduced to their minimum before the shuffle,
    and a hub's edges meet their labels in a plain join, which Spark splits when it is
    skewed. Every round is written, so a lost executor costs one round at most.
    """
    both = edges.select("a", "b").filter("a <> b")
    edges = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.first("a").alias("label")))
    turn = 0
    while not edges.isEmpty():
        ranked = F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b"))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("b"))
        near = edges.groupBy("a").agg(F.min(ranked).alias("best"))
        joins = cut(near.select(F.col("a").alias("old"), F.least("best", own)["b"].alias("new")))
        labels = cut(
            labels.join(joins, labels["label"] == joins["old"], "left").select(
                "node", F.coalesce("new", "label").alias("label")
            )
        )
        one = edges.join(joins, edges["a"] == joins["old"]).select(F.col("new").alias("a"), "b")
        two = one.join(joins, one["b"] == joins["old"]).select("a", F.col("new").alias("b"))
        edges = cut(two.filter("a <> b").distinct())
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")

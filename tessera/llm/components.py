"""Connected components of a graph given as edges, by alternating star operations.

Large stars link every larger neighbour of a node to its smallest neighbour, small stars every smaller one; both shrink
the graph to stars around each component's smallest node in a logarithmic number of rounds in practice (Kiveris and others,
2014). Every round is a shuffle of the edges; nothing passes through the driver but the number of edges that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on distinct edges u > v."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(linked.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge. Nulls, loops and repeats are ignored."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now, last, turn = scratch.table(now, "edges0"), None, 0
    while True:
        after = scratch.table(_star(_star(now, True), False), f"edges{1 - turn}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        scratch.drop(f"edges{turn}")
        now, turn = after, 1 - turn
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

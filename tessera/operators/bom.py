"""Bills of material: recursive joins of edges (parent, child, qty) level by level, with a guard against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode(edges: DataFrame, tops: DataFrame, most_levels: int = 1000) -> DataFrame:
    """top, item, level, qty (accumulated), cycle: every path below the tops, one row each; a cycle is reported and left.

    Levels are added until there is no new one; a bill of more than ``most_levels`` is an error, never cut. As the plan runs later, the session's
    ``spark.sql.cteRecursionRowLimit`` stays lifted. Shared assemblies give a row for each path to them, so rows grow with the paths.
    The edges are as many as the parts and join once a level, so they are shuffled: a broadcast would pass them through the driver each time.
    """
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows are not bounded, by default they are by a million
    edges.createOrReplaceTempView("tessera_bom_edges")
    tops.createOrReplaceTempView("tessera_bom_tops")
    return spark.sql(f"""
        WITH RECURSIVE tree MAX RECURSION LEVEL {most_levels + 1} AS (
            SELECT top, top AS item, 0 AS level, CAST(1 AS DOUBLE) AS qty, array(top) AS path, false AS cycle FROM tessera_bom_tops
            UNION ALL
            SELECT /*+ MERGE(e) */ t.top, e.child, t.level + 1, t.qty * e.qty, array_append(t.path, e.child), array_contains(t.path, e.child)
            FROM tree t JOIN tessera_bom_edges e ON e.parent = t.item WHERE NOT t.cycle)
        SELECT top, item, level, qty, cycle FROM tree WHERE level > 0""")


def where_used(edges: DataFrame, items: DataFrame, most_levels: int = 1000) -> DataFrame:
    """item, used_in, level: the chain upward from each item."""
    up = explode(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "qty"), items.select(F.col("item").alias("top")), most_levels)
    return up.where("not cycle").groupBy(F.col("top").alias("item"), F.col("item").alias("used_in")).agg(F.min("level").alias("level"))


def roots(edges: DataFrame) -> DataFrame:
    """top: every parent that is no child."""
    return edges.select(F.col("parent").alias("top")).distinct().join(edges.select(F.col("child").alias("top")).hint("merge"), "top", "left_anti")


def roll_up_cost(exploded: DataFrame, costs: DataFrame, edges: DataFrame) -> DataFrame:
    """top, cost: accumulated quantity times unit cost of the leaves."""
    leaves = exploded.join(edges.select(F.col("parent").alias("item")).distinct().hint("merge"), "item", "left_anti")
    return leaves.join(costs.hint("merge"), "item").groupBy("top").agg(F.sum(F.col("qty") * F.col("cost")).alias("cost"))

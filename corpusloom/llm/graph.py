"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.store import written


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").where("v <> least").select(F.col("v").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge (a, b): the smallest node each can reach.

    Alternates large-star and small-star steps until nothing changes; every step is a minimum
    per node, combined before its shuffle, and a join that may be split where it is skewed.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct())
    state = None
    while True:
        now = written(_small(_large(now)))
        new = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if new == state or new[0] == 0:
            break
        state = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots))

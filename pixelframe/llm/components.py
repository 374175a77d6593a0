"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation (pre-combined before its shuffle) and a join on the node, so a node
with very many neighbours is no unbounded group; edges never go to the driver.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node that it is connected to.

    Edges may repeat, point either way or be loops; those with a null end are left out. An empty table gives an
    empty result.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = cut(e)
    state = _state(e)
    while state[0]:
        e = cut(_small_star(_large_star(e)))
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum."""
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(e: DataFrame) -> DataFrame:
    """Joins the larger neighbours of every node to the smallest of node and neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Joins every node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    moved = e.join(least, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()

"""Connected components by alternating star contraction.

Each round replaces the links by links to the smallest neighbour (large star, then small
star). Only aggregates by node and joins on it are used: no group is collected, a hot
node costs one partial aggregate, and the number of rounds follows the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("x").agg(F.min("y").alias("m"))
    moved = edges.join(low, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.union(low.select("x", F.col("m").alias("y"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node that has a smaller neighbour has one only, and that one has none."""
    chained = edges.join(edges.select(F.col("x").alias("y")).distinct(), "y", "left_semi").isEmpty()
    return chained and edges.groupBy("x").count().filter("count > 1").isEmpty()


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has a link to another one.

    ``component`` is the smallest node of the component. Links to itself and links with
    a null end are left out; an empty table gives an empty table.
    """
    edges = links.select(F.greatest(left, right).alias("x"), F.least(left, right).alias("y"))
    edges = saved(edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct(), "links")
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = saved(_small_star(_large_star(edges)), "links")
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(
        edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )

"""Connected components over an edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each step is a minimum per node and
a join back, so no neighbour list is ever collected: a node with very many
neighbours is reduced by partial aggregation, and its side of the join is one
row, which adaptive execution can copy to the pieces of a skewed partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
            )
        ).alias("e")
    ).select("e.*")


def _smallest(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("node").agg(F.min("other").alias("low")).select(
        "node", F.least("node", "low").alias("low")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour."""
    near = _both_ways(edges)
    return (
        near.filter(F.col("other") > F.col("node"))
        .join(_smallest(near), "node")
        .select(F.col("other").alias("a"), F.col("low").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    low = down.groupBy("node").agg(F.min("other").alias("low"))
    moved = down.join(low, "node").select(F.col("other").alias("a"), F.col("low").alias("b"))
    kept = low.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(kept).filter("a <> b").distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points anywhere."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")),
                F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")),
            )
        ).alias("e")
    ).select("e.*")
    per_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per_node.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with an edge; root is the smallest member.

    ``edges`` is read several times and should be a written table.
    """
    current = (
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter("a <> b")
        .distinct()
    )
    while not _is_settled(current):
        current = materialize(_small_star(_large_star(current)), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components over edge tables of any size.

Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014):
every round is two groupings by node with partial aggregation, so a node with
very many edges costs its share of the edges and no task holds its neighbours.
The number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller and equal) neighbours of each node to its least neighbour."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: two columns of one type.  Returns node, component (the least node it reaches).

    Nodes without edges are not listed.  Ends when no edge changes.
    """
    a, b = edges.columns
    current = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        sign = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == before:
            break
        before = sign
        current = cut(_stars(_stars(current, True), False))
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).distinct()

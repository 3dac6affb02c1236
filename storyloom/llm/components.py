"""Connected components over an edge table, by alternating stars.

Large-star and small-star rounds (Kiveris et al., 2014) move every edge
towards the least node of its neighbourhood until the graph is a set of stars.
A round is two aggregates and two joins on the edge table; neighbourhoods are
never gathered, so a node with very many edges costs rows, not one task's
memory.  Each round is written to the shared folder and replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import cut_lineage, forget


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where(F.col("u") != F.col("v")).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes with two parents, or with a parent and children: none if all
    components are stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count(F.when(F.col("up") + F.least("up", "down") > 1, 1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v; loops and
    repeats allowed); ``root`` is the least node of the component."""
    state = cut_lineage(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unsettled(state):
        step = cut_lineage(_small_star(_large_star(state)))
        forget(state)
        state = step
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

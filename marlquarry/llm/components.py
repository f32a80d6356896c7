"""Connected components of an edge list, as alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.workspace import Workspace, split_join


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of them. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = split_join(edges, least, ["u"])
    out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges that one file of a written pass holds, about.
EDGES = 250_000


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent or is one: then each star is a component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, ws: Workspace, label: str = "cc") -> DataFrame:
    """(node, root) for each node with an edge; root is the least node that it reaches.

    edges has the columns a and b. Loops and repeated edges do no harm; no edges give no rows. Each pass
    is written as a table, so a lost executor costs one pass. The edge list never leaves the cluster: only its count does,
    and whether it consists of stars.
    """
    state = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = ws.table(state, f"{label}-0")
    step = 0
    while not _stars(state):
        step += 1
        files = state.count() // EDGES + 1
        state = ws.table(_small_star(_large_star(state)), f"{label}-{step}", files)
        ws.drop(f"{label}-{step - 1}")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

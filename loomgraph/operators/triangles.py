"""Triangles of undirected graphs, and relabelling by degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.functions.scalar import int_div
from loomgraph.operators.access import all_degrees
from loomgraph.operators.graph import Graph, symmetrize
from loomgraph.plans.workspace import Workspace


def _oriented(edges: DataFrame) -> DataFrame:
    """Each pair once, from the vertex of lower degree (then id) to the other: no vertex keeps more than
    about the square root of twice the edges, so hot vertices spread over their neighbours."""
    pairs = symmetrize(edges)
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    # Written, so that both sides of the joins are plain shuffles and a hub's rows can go to several tasks.
    degree = Workspace(edges.sparkSession, "triangles").save(degree)
    known = pairs.join(degree.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    low = F.when(forward, F.struct(F.col("src").alias("v"), F.col("ds").alias("d"))).otherwise(F.struct(F.col("dst").alias("v"), F.col("dd").alias("d")))
    high = F.when(forward, F.struct(F.col("dst").alias("v"), F.col("dd").alias("d"))).otherwise(F.struct(F.col("src").alias("v"), F.col("ds").alias("d")))
    return known.select(low.alias("a"), high.alias("b")).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.col("b.d").alias("d"))


def triangle_count(graph: Graph) -> DataFrame:
    """(triangles): each once; repeated edges, directions and self-loops do not count."""
    oriented = _oriented(graph.edges)
    left = oriented.select("a", F.col("b").alias("x"), F.col("d").alias("dx"))
    right = oriented.select("a", F.col("b").alias("y"), F.col("d").alias("dy"))
    wedges = left.join(right, "a").where(F.struct("dx", "x") < F.struct("dy", "y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return wedges.join(oriented.select("a", "b"), ["a", "b"], "left_semi").agg(F.count("*").alias("triangles"))


def triangle_count_by_lists(graph: Graph) -> DataFrame:
    """The same by intersecting sorted neighbour lists of the two ends of each edge."""
    oriented = _oriented(graph.edges).select("a", "b")
    lists = oriented.groupBy("a").agg(F.collect_list("b").alias("n"))
    ends = oriented.join(lists, "a").join(lists.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    return ends.agg(F.coalesce(F.sum(F.size(F.array_intersect("n", "m"))), F.lit(0)).cast("long").alias("triangles"))


def degree_relabel(graph: Graph) -> DataFrame:
    """(v, new_id): ranks by degree in both directions, highest first, of equal ones the larger id first.

    Ranks come from counts by degree and a rank inside each degree and id block, not from one sorted task.
    """
    width = max(1, graph.vertex_count // 1024)
    known = all_degrees(graph).withColumn("block", int_div(F.col("v"), width))
    counts = known.groupBy("degree", "block").agg(F.count("*").alias("n"))
    per_degree = counts.groupBy("degree").agg(F.sum("n").alias("total"))
    above = per_degree.withColumn("above", F.sum("total").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)))
    ahead = F.sum("n").over(Window.partitionBy("degree").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("ahead", ahead).join(above, "degree").select("degree", "block", (F.coalesce("above", F.lit(0)) + F.coalesce("ahead", F.lit(0))).alias("base"))
    within = F.row_number().over(Window.partitionBy("degree", "block").orderBy(F.desc("v"))) - 1
    return known.withColumn("within", within).join(base, ["degree", "block"]).select("v", (F.col("base") + F.col("within")).alias("new_id"))

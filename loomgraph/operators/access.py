"""Degrees, neighbours, scans and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.operators.graph import Graph
from loomgraph.plans.workspace import Workspace


def _degrees(graph: Graph, *ends: str) -> DataFrame:
    """(v, degree) of every vertex: a 1 for each edge end and a 0 for each vertex, summed in one shuffle.

    Partial sums before the shuffle keep hot vertices cheap.
    """
    rows = graph.vertices().select("v", F.lit(0).cast("long").alias("one"))
    for end in ends:
        rows = rows.unionByName(graph.edges.select(F.col(end).alias("v"), F.lit(1).cast("long").alias("one")))
    return rows.groupBy("v").agg(F.sum("one").alias("degree"))


def out_degrees(graph: Graph) -> DataFrame:
    """(v, degree): edges that leave v, repeated ones counted."""
    return _degrees(graph, "src")


def in_degrees(graph: Graph) -> DataFrame:
    return _degrees(graph, "dst")


def all_degrees(graph: Graph) -> DataFrame:
    """Edges in and out; a self-loop counts twice."""
    return _degrees(graph, "src", "dst")


def nonempty(graph: Graph) -> DataFrame:
    """(v): vertices that an edge leaves."""
    return graph.edges.select(F.col("src").alias("v")).distinct()


def neighbors_out(graph: Graph, frontier: DataFrame) -> DataFrame:
    """(v, neighbor) for each edge that leaves a vertex v of the frontier, with its weight if edges have one."""
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    return graph.edges.join(frontier.select(F.col("v").alias("src")), "src").select(F.col("src").alias("v"), F.col("dst").alias("neighbor"), *rest)


def neighbors_in(graph: Graph, frontier: DataFrame) -> DataFrame:
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    return graph.edges.join(frontier.select(F.col("v").alias("dst")), "dst").select(F.col("dst").alias("v"), F.col("src").alias("neighbor"), *rest)


def with_neighbor_in(graph: Graph, vertices: DataFrame, frontier: DataFrame) -> DataFrame:
    """The vertices of which some edge comes from the frontier; a search that stops at the first one."""
    hit = graph.edges.join(frontier.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v"))
    return vertices.join(hit, "v", "left_semi")


def range_scan(graph: Graph, first: int, end: int) -> DataFrame:
    """Edges whose source is in [first, end); the bounds reach the Parquet scan."""
    return graph.edges.where((F.col("src") >= first) & (F.col("src") < end))


def ordered_neighbors(graph: Graph) -> DataFrame:
    """(v, neighbors): ascending, with repeats, of every vertex that an edge leaves.

    A list is one row; where hubs have more neighbours than a row should hold, ``placed_neighbors`` gives rows.
    """
    return graph.edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def placed_neighbors(graph: Graph) -> DataFrame:
    """(v, place, neighbor): the same order as rows, places from 0; a hub's neighbours spread over parts.

    The sorted table is written once with each row's place in its part. What a vertex has in earlier parts is a
    running sum over the parts it lies in.
    """
    work = Workspace(graph.spark, "places")
    at = F.monotonically_increasing_id()
    rows = work.save(
        graph.edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
        .select("src", "dst", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    starts = rows.groupBy("src", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = work.save(starts.withColumn("before", before).drop("n"))
    place = F.col("before") + F.col("at") - F.col("start")
    return rows.join(starts, ["src", "part"]).select(F.col("src").alias("v"), place.alias("place"), F.col("dst").alias("neighbor"))


def sample_neighbors(graph: Graph, k: int) -> DataFrame:
    """(v, place, neighbor): the k smallest neighbours of each vertex, places from 0.

    A first cut of k in each part of a hot vertex's edges goes before the cut over all of them.
    """
    part = F.pmod(F.xxhash64("dst", F.monotonically_increasing_id()), F.lit(32))
    salted = graph.edges.select("src", "dst", part.alias("part"))
    local = Window.partitionBy("src", "part").orderBy("dst")
    cut = salted.withColumn("n", F.row_number().over(local)).where(F.col("n") <= k)
    place = (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long")
    return cut.withColumn("place", place).where(F.col("place") < k).select(F.col("src").alias("v"), "place", F.col("dst").alias("neighbor"))


def adjacency(graph: Graph, both: bool = False) -> DataFrame:
    """(v, out_list[, in_list]) of every vertex, ascending; empty lists where there is no edge."""
    out = graph.edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("out_list"))
    empty = F.array().cast("array<long>")
    found = graph.vertices().join(out, "v", "left").withColumn("out_list", F.coalesce("out_list", empty))
    if both:
        into = graph.edges.groupBy(F.col("dst").alias("v")).agg(F.sort_array(F.collect_list("src")).alias("in_list"))
        found = found.join(into, "v", "left").withColumn("in_list", F.coalesce("in_list", empty))
    return found

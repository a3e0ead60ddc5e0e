"""Histograms of degrees and of blocks of consecutive ids, and how skewed a graph is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.scalar import bit_width, int_div
from loomgraph.operators.access import all_degrees, in_degrees, out_degrees
from loomgraph.operators.graph import Graph

#: Degrees below this have a bar of their own.
EXACT_BELOW = 1024
#: Blocks with fewer edges than this are looked at in detail.
SMALL_BLOCK = 128


def _degrees(graph: Graph, side: str) -> DataFrame:
    return {"out": out_degrees, "in": in_degrees, "all": all_degrees}[side](graph)


def _running(value: str, order: str) -> Column:
    """A running sum over a small, already aggregated table."""
    return F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def degree_histogram(graph: Graph, side: str) -> DataFrame:
    """(degree, vertices, percent) of degrees below 1024; percent is of all vertices."""
    rows = _degrees(graph, side).where(F.col("degree") < EXACT_BELOW).groupBy("degree").agg(F.count("*").alias("vertices"))
    return rows.withColumn("percent", F.col("vertices") * 100.0 / graph.vertex_count)


def degree_histogram_log(graph: Graph, side: str) -> DataFrame:
    """(width, vertices, percent) by the binary digits of the degree, of all vertices."""
    rows = _degrees(graph, side).groupBy(bit_width(F.col("degree")).alias("width")).agg(F.count("*").alias("vertices"))
    return rows.withColumn("percent", F.col("vertices") * 100.0 / graph.vertex_count)


def degree_histogram_split(graph: Graph, side: str = "out", exact_below: int = EXACT_BELOW) -> DataFrame:
    """(kind, bucket, vertices): exact bars below the limit, bars by binary digits from it on."""
    exact = F.col("degree") < exact_below
    rows = _degrees(graph, side).select(
        F.when(exact, "exact").otherwise("log").alias("kind"), F.when(exact, F.col("degree")).otherwise(bit_width(F.col("degree"))).cast("long").alias("bucket")
    )
    return rows.groupBy("kind", "bucket").agg(F.count("*").alias("vertices"))


def unit_blocks(graph: Graph, unit: int) -> DataFrame:
    """(block, edges, active, max_degree) of every block of ``unit`` consecutive ids, by out-degree."""
    return (
        out_degrees(graph).groupBy(int_div(F.col("v"), unit).alias("block"))
        .agg(F.sum("degree").alias("edges"), F.count_if(F.col("degree") > 0).alias("active"), F.max("degree").alias("max_degree"))
    )


def segment_units(edges: DataFrame, segment: str, unit: int) -> DataFrame:
    """(segment, width, blocks, edges): in each segment of a file, its blocks of sources by binary digits of their edges."""
    counts = edges.groupBy(segment, int_div(F.col("src"), unit).alias("block")).agg(F.count("*").alias("n"))
    return counts.groupBy(segment, bit_width(F.col("n")).alias("width")).agg(F.count("*").alias("blocks"), F.sum("n").alias("edges"))


def unit_histogram(blocks: DataFrame, value: str) -> DataFrame:
    """(value, blocks): how many blocks have each number of edges (or active vertices)."""
    return blocks.groupBy(value).agg(F.count("*").alias("blocks"))


def small_unit_histogram(blocks: DataFrame, value: str, below: int = SMALL_BLOCK) -> DataFrame:
    """(edges, value, blocks) of the blocks with few edges."""
    return blocks.where(F.col("edges") < below).groupBy("edges", value).agg(F.count("*").alias("blocks"))


def unit_cumulative(blocks: DataFrame) -> DataFrame:
    """By rising edges a block: cumulative percent of blocks and edges, the share of used slots and the
    space relative to the edges if every block had that many slots; the last two are null at 0."""
    bars = unit_histogram(blocks, "edges").select("edges", "blocks", (F.col("edges") * F.col("blocks")).alias("held"))
    total = bars.agg(F.sum("blocks").alias("u"), F.sum("held").alias("e"))
    rows = bars.select("edges", _running("blocks", "edges").alias("acc_blocks"), _running("held", "edges").alias("acc_edges")).crossJoin(F.broadcast(total))
    slots = F.col("u") * F.col("edges")
    used = (F.col("acc_edges") + (F.col("u") - F.col("acc_blocks")) * F.col("edges")) / slots
    return rows.select(
        "edges", (F.col("acc_blocks") * 100.0 / F.col("u")).alias("blocks_percent"), (F.col("acc_edges") * 100.0 / F.col("e")).alias("edges_percent"),
        F.when(F.col("edges") > 0, used).alias("utilisation"), F.when(F.col("e") > 0, slots / F.col("e")).alias("space_ratio"),
    )


def active_percent(blocks: DataFrame) -> DataFrame:
    """(edges, active, percent) for blocks of 1, 2, 4, ... 64 edges: percent of the blocks with that many edges."""
    rows = small_unit_histogram(blocks.where(F.col("edges").isin(*(1 << i for i in range(7)))), "active")
    return rows.select("edges", "active", (F.col("blocks") * 100.0 / F.sum("blocks").over(Window.partitionBy("edges"))).alias("percent"))


def max_degree_cumulative(blocks: DataFrame) -> DataFrame:
    """(edges, max_degree, percent) for blocks of 1, 2, 4, ... 64 edges: running percent by largest degree."""
    rows = small_unit_histogram(blocks.where(F.col("edges").isin(*(1 << i for i in range(7)))), "max_degree")
    run = Window.partitionBy("edges").orderBy("max_degree").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("edges", "max_degree", (F.sum("blocks").over(run) * 100.0 / F.sum("blocks").over(Window.partitionBy("edges"))).alias("percent"))


def skewness(graph: Graph, percents: tuple[int, ...] = (1, 10)) -> DataFrame:
    """(percent, vertices, edges, share) on the vertices of highest out-degree; their number is the given
    percent of the largest source id, rounded down.

    Works on counts by degree: which of equal vertices are in does not change the sums.
    """
    bars = out_degrees(graph).groupBy("degree").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = bars.withColumn("upto", run)
    top = graph.edges.agg(F.max("src").alias("top"), F.count("*").alias("all"))
    wanted = graph.spark.createDataFrame([(p,) for p in percents], "percent int").crossJoin(top).withColumn("vertices", int_div(F.col("top") * F.col("percent"), 100))
    taken = F.greatest(F.lit(0), F.least("n", F.col("vertices") - (F.col("upto") - F.col("n"))))
    return (
        ranked.crossJoin(F.broadcast(wanted)).groupBy("percent", "vertices", "all").agg(F.sum(taken * F.col("degree")).alias("edges"))
        .select("percent", "vertices", "edges", (F.col("edges") / F.col("all")).alias("share"))
    )


def density(graph: Graph) -> DataFrame:
    """(vertices, edges, density): edges for each vertex."""
    return graph.edges.agg(F.count("*").alias("edges"), (F.greatest(F.max("src"), F.max("dst")) + 1).alias("vertices")).select(
        "vertices", "edges", (F.col("edges") / F.col("vertices")).alias("density")
    )

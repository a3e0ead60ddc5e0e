"""Weakly connected components labelled by their smallest vertex id.

The loop alternates two star contractions. In the large star every vertex hands its larger
neighbours to its smallest neighbour; in the small star it hands its smaller ones. Each round is two
joins and two minimum aggregations whose partial sums run before the shuffle, and chains shrink in
logarithmically many rounds. A star's centre has a row for each of its neighbours on one key of the join; of
tables beyond ``LARGE`` edges the minima are written first, so that both sides of the join are plain shuffles
and adaptive execution can deal such a key to several tasks. What has ``SMALL`` edges or fewer, at first or after
some rounds, is closed by one task in bounded memory: a round is some ten stages, each with a task for every
shuffle partition, and the driver keeps a record of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.graph import Graph
from loomgraph.plans.shipping import ship
from loomgraph.plans.workspace import Workspace

#: Graphs with this many edges or fewer are closed by one task, which holds their vertices.
SMALL = 100_000
#: Tables with more edges than this may hold stars that are too large for a task.
LARGE = 5_000_000


def _toward_minimum(pairs: DataFrame, larger: bool, keep: Workspace | None = None) -> DataFrame:
    """One star contraction of ``pairs`` (u, v); u is the centre. ``keep`` writes the minima first."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    lowest = keep.save(lowest, "uncompressed") if keep else lowest
    joined = pairs.join(lowest, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v")))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, component) of all ends of the edges (u, v), by union-find with the smaller root on top."""
    above: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := above.setdefault(v, v)) != v:
            above[v] = above[up]
            v = up
        return v

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    if above:
        vertices = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.array(map(root, vertices), pa.int64())], ["v", "component"])


def star_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(v, component) of every vertex that has an edge to another one.

    ``edges`` has long columns (u, v). Self loops, repeated edges and either direction are fine, rows
    with a null end are no edges, and no edges give no rows. Ends when a round changes nothing.
    """
    current = workspace.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "uncompressed",
    )
    before, size = None, current.count()
    while True:
        if size <= SMALL:
            ship(current.sparkSession)
            return workspace.save(current.select("u", "v").coalesce(1).mapInArrow(_closed, "v long, component long"), "uncompressed")
        keep = workspace if size > LARGE else None
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = workspace.save(_toward_minimum(both, True, keep).where("u <> v").distinct(), "uncompressed")
        small = _toward_minimum(large, False, keep).where("u <> v")
        following = workspace.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "uncompressed")
        workspace.drop(current, large)
        current = following
        # The multiset of edges is fixed exactly when every vertex points at its component's minimum.
        state = current.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before:
            break
        before, size = state, state["n"]
    members = current.select(F.col("u").alias("v"), F.col("v").alias("component"))
    roots = members.select("component").distinct().select(F.col("component").alias("v"), "component")
    return workspace.save(members.unionByName(roots), "uncompressed")


def connected_components(graph: Graph) -> DataFrame:
    """(v, component) of every vertex: the smallest id that edges in either direction connect it with."""
    work = Workspace(graph.spark, "components")
    linked = star_components(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), work)
    return graph.vertices().join(linked, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def link(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One step: every vertex takes the least label of its own and its neighbours', either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    offered = both.join(labels, both["src"] == labels["v"]).select(F.col("dst").alias("v"), "component")
    return labels.unionByName(offered).groupBy("v").agg(F.min("component").alias("component"))


def compress(labels: DataFrame) -> DataFrame:
    """One pointer jump: every vertex takes its label's label."""
    of = labels.select(F.col("v").alias("component"), F.col("component").alias("next"))
    return labels.join(of, "component", "left").select("v", F.coalesce("next", "component").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def top_pairs(pairs: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest values, of equal ones the larger keys."""
    return pairs.orderBy(F.desc(value), F.desc(key)).limit(k)


def component_report(labels: DataFrame, k: int = 5) -> DataFrame:
    """(component, size, components): the k largest, with the number of all."""
    sizes = component_sizes(labels)
    count = sizes.agg(F.count("*").alias("components"))
    return top_pairs(sizes, "component", "size", k).crossJoin(F.broadcast(count))


def most_frequent(labels: DataFrame) -> DataFrame:
    """The label with the most vertices, exactly; of equal ones the smallest."""
    return component_sizes(labels).orderBy(F.desc("size"), "component").limit(1)

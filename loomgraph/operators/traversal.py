"""Breadth-first levels: 1 at the root, 0 where it does not reach.

A level is expanded from the frontier's edges, or, once the frontier is a large part of the graph, by asking
the unvisited vertices for an edge from it. Each such level is one query whose vertices are written to the
workspace, which cuts lineage. A frontier of up to ``NARROW`` vertices is expanded by the driver instead, which asks
for its edges' ends and keeps up to about ``KEPT`` vertices before they are written, so that a level of a long chain
costs one or two small queries. All ways give the same levels.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.graph import Graph
from loomgraph.operators.keyed import KeyedEdges, among
from loomgraph.plans.workspace import Workspace

#: A frontier of this part of the vertices or more is expanded from the unvisited side.
BOTTOM_UP = 0.002
#: The tables of this many levels become one, so that deep graphs keep small plans.
MERGE_LEVELS = 12
#: A frontier of so many vertices is expanded by the driver, if it has at most ``AHEAD`` edges; beyond, by joins.
NARROW, AHEAD = 1000, 10_000
#: Vertices that the driver holds before it writes them.
KEPT = 100_000
#: After so many levels expanded by the driver, the tables of what is reached become one.
SETTLED = 3


class _Reached:
    """What is reached so far: written tables, and rows on the driver that are not written yet."""

    def __init__(self, work: Workspace):
        self.work = work
        self.tables: list[DataFrame] = []
        self.held: dict[int, int] = {}

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)

    def add(self, table: DataFrame) -> None:
        self.tables.append(table)
        if len(self.tables) > MERGE_LEVELS:
            self.merge()

    def merge(self) -> None:
        if len(self.tables) > 1:
            self.tables = [self.work.save(self.all().sortWithinPartitions("v"), "uncompressed")]

    def hold(self, found: Iterable[int], level: int) -> None:
        self.held.update((v, level) for v in found)
        if len(self.held) > KEPT:
            self.write()

    def write(self) -> None:
        if self.held:
            rows = self.work.spark.createDataFrame(list(self.held.items()), "v long, level int")
            self.held = {}
            self.add(self.work.save(rows, "uncompressed"))

    def unseen(self, ids: set[int]) -> set[int]:
        """Those of a few vertices that are not reached yet."""
        ids = {v for v in ids if v not in self.held}
        if ids and self.tables:
            ids -= {r["v"] for r in self.all().where(among("v", ids)).select("v").collect()}
        return ids


def _levels(graph: Graph, start: DataFrame, keys: list[str], bottom_up: bool, max_levels: int | None) -> DataFrame:
    """(keys, v, level) of all that is reached from ``start`` (keys, v). The driver expands no levels with keys."""
    work = Workspace(graph.spark, "bfs")
    edges = KeyedEdges(graph.edges.select("src", "dst"), graph.edge_count)
    try:
        reached = _Reached(work)
        few = None  # the frontier's vertices while the driver expands it
        settled = 0
        first = [] if keys else start.limit(NARROW + 1).collect()
        if not keys and len(first) <= NARROW:
            few = {r["v"] for r in first}
            reached.hold(few, 1)
            size = len(few)
        else:
            frontier = work.save(start.withColumn("level", F.lit(1)), "uncompressed")
            reached.add(frontier)
            size = frontier.count() if bottom_up or not keys else 0
        for level in count(2):
            if max_levels is not None and level > max_levels:
                break
            if not keys and size <= NARROW:
                few = {r["v"] for r in frontier.select("v").collect()} if few is None else few
                ends = edges.ends(few, AHEAD) if few else set()
                if ends is not None:
                    settled += 1
                    if settled == SETTLED:
                        reached.merge()
                    few = reached.unseen(ends)
                    reached.hold(few, level)
                    size = len(few)
                    if not size:
                        break
                    continue
            if few is not None:
                reached.write()
                frontier = reached.all().where(F.col("level") == level - 1)
                few = None
            settled = 0
            visited = reached.all().select(*keys, "v")
            large = bottom_up and size >= BOTTOM_UP * graph.vertex_count
            if large:
                unvisited = graph.vertices().join(visited, "v", "left_anti")
                hit = edges.join(frontier.select("v"), "left_semi").select(F.col("dst").alias("v"))
                found = unvisited.join(hit, "v", "left_semi")
            else:
                ahead = edges.join(frontier.select(*keys, "v")).select(*keys, F.col("dst").alias("v")).distinct()
                found = ahead.join(visited, [*keys, "v"], "left_anti")
            frontier = work.save(found.withColumn("level", F.lit(level)), "uncompressed")
            size = frontier.count()
            if not size:
                break
            reached.add(frontier)
        reached.write()
        return reached.all() if reached.tables else start.withColumn("level", F.lit(1))
    finally:
        edges.release()


def bfs(graph: Graph, root: int, bottom_up: bool = True, max_levels: int | None = None) -> DataFrame:
    """(v, level) of every vertex, along the edges' direction; ``max_levels`` ends the search earlier."""
    start = graph.vertices().where(F.col("v") == root)
    reached = _levels(graph, start, [], bottom_up, max_levels)
    return graph.vertices().join(reached, "v", "left").select("v", F.coalesce("level", F.lit(0)).alias("level"))


def bfs_reverse(graph: Graph, root: int) -> DataFrame:
    """Levels against the edges' direction."""
    return bfs(graph.reversed(), root)


def bfs_many(graph: Graph, roots: list[int], max_levels: int | None = None) -> DataFrame:
    """(root, v, level) of what each root reaches; all roots advance in one query a level."""
    start = graph.vertices().where(F.col("v").isin(roots)).select(F.col("v").alias("root"), "v")
    return _levels(graph, start, ["root"], False, max_levels)


def frontier_counts(levels: DataFrame) -> DataFrame:
    """(level, vertices) of what is reached."""
    return levels.where("level > 0").groupBy("level").agg(F.count("*").alias("vertices"))

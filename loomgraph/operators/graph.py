"""The graph: a multigraph of directed edges over the dense vertex range 0..V-1.

Edges are rows ``(src, dst)``, with an optional ``weight``. Repeated edges and self-loops count.
Every id below V is a vertex, whether an edge names it or not.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge turned around; other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; a self-loop twice."""
    return edges.unionByName(reverse(edges))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each connected pair once, smaller id first; no self-loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


class Graph:
    """Edges and the size of the vertex range, which is found from the edges unless it is given."""

    def __init__(self, edges: DataFrame, vertex_count: int | None = None):
        self.edges = edges
        self._vertex_count = vertex_count

    @cached_property
    def vertex_count(self) -> int:
        if self._vertex_count is not None:
            return self._vertex_count
        top = self.edges.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0]
        return 0 if top is None else top + 1

    @cached_property
    def edge_count(self) -> int:
        return self.edges.count()

    @property
    def spark(self):
        return self.edges.sparkSession

    def vertices(self) -> DataFrame:
        return self.spark.range(self.vertex_count).select(F.col("id").alias("v"))

    def reversed(self) -> Graph:
        return Graph(reverse(self.edges), self._vertex_count)

    def undirected(self) -> Graph:
        return Graph(undirected(self.edges), self._vertex_count)

    def add(self, batch: DataFrame) -> Graph:
        """The graph with a further batch; the vertex range grows as needed."""
        return Graph(self.edges.unionByName(batch))

    def add_undirected(self, batch: DataFrame) -> Graph:
        return Graph(self.edges.unionByName(undirected(batch)))

    def snapshot(self, key: str = "src") -> Graph:
        """A fixed version, kept partitioned by one end for repeated joins.

        Partitions that are lost with an executor are made again from the source.
        """
        kept = self.edges.repartition(F.col(key)).persist(StorageLevel.MEMORY_AND_DISK)
        return Graph(kept, self.vertex_count)

    def release(self) -> None:
        self.edges.unpersist()

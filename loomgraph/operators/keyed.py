"""Edges kept for repeated joins by source."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

#: A source with more edges than this, and than this part of all, is hot: its edges are kept in several parts.
HOT_EDGES = 1_000_000
HOT_PART = 1e-4


def among(column: str, ids: set[int]) -> str:
    """SQL for a column that is one of a few ``ids``, with their range, by which sorted tables are read in part."""
    ordered = sorted(ids)
    return f"{column} BETWEEN {ordered[0]} AND {ordered[-1]} AND {column} IN ({', '.join(map(str, ordered))})"


class KeyedEdges:
    """``edges`` (src, dst, ...) partitioned and sorted by source and held on the executors.

    A join with a frame keyed by vertex then moves the frame only. The edges of hot sources are dealt to
    several parts and the frame's rows for them are repeated as often. At most 1 / HOT_PART sources can
    be hot, so their table is always small enough for every task. Parts that are lost are made again.
    """

    def __init__(self, edges: DataFrame, edge_count: int):
        limit = max(HOT_EDGES, int(HOT_PART * edge_count))
        counts = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > limit) if edge_count > limit else None
        found = [(r["src"], -(-r["n"] // limit)) for r in counts.collect()] if counts is not None else []
        self.hot = edges.sparkSession.createDataFrame(found, "src long, _parts int") if found else None
        if self.hot is None:
            dealt = edges.repartition(F.col("src")).sortWithinPartitions("src")
        else:
            part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_parts").cast("long")), F.lit(0).cast("long"))
            dealt = edges.join(F.broadcast(self.hot), "src", "left").withColumn("_part", part).drop("_parts").repartition("src", "_part").sortWithinPartitions("src", "_part")
        self.edges = dealt.persist(StorageLevel.MEMORY_AND_DISK)

    def join(self, frame: DataFrame, how: str = "inner") -> DataFrame:
        """Edges with the frame's columns, where src is the frame's ``v``; ``how`` may be left_semi."""
        keyed = frame.withColumnRenamed("v", "src")
        if self.hot is None:
            return self.edges.join(keyed, "src", how)
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
        spread = keyed.join(F.broadcast(self.hot), "src", "left").withColumn("_part", part).drop("_parts")
        return self.edges.join(spread, ["src", "_part"], how).drop("_part")

    def ends(self, sources: set[int], limit: int) -> set[int] | None:
        """Where the edges of a few sources end, on the driver; None if that takes more than ``limit`` edges."""
        of = self.edges.where(among("src", sources)).where("dst IS NOT NULL")
        rows = of.select("dst").limit(limit + 1).collect()
        return {r["dst"] for r in rows} if len(rows) <= limit else None

    def release(self) -> None:
        self.edges.unpersist()

"""PageRank in two recurrences. Updates are simultaneous: an iteration sees the one before only.

An iteration joins the scores with the edges, kept partitioned by source, and sums by target. As sums
come out partitioned by vertex, the next join shuffles the edges no more. Every few iterations the
scores are written, which cuts lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.access import out_degrees
from loomgraph.operators.graph import Graph
from loomgraph.operators.keyed import KeyedEdges
from loomgraph.plans.workspace import Workspace

DAMPING = 0.85
SAVE_EVERY = 5


class _Kept:
    """Distinct edges with their weight (repeats over the source's degree), partitioned by source."""

    def __init__(self, graph: Graph):
        degrees = out_degrees(graph)
        weighted = (
            graph.edges.groupBy("src", "dst").agg(F.count("*").alias("times"))
            .join(degrees.select(F.col("v").alias("src"), "degree"), "src")
            .select("src", "dst", (F.col("times") / F.col("degree")).alias("share"), "times")
        )
        self.edges = KeyedEdges(weighted, graph.edge_count)
        self.zero = graph.vertices().select("v", F.lit(0.0).alias("x"))
        self.has_out = graph.edges.select(F.col("src").alias("v")).distinct()

    def incoming(self, scores: DataFrame, weight: str) -> DataFrame:
        """(v, x): the weighted sum over the edges into v; 0 where there is none."""
        sent = self.edges.join(scores).select(F.col("dst").alias("v"), (F.col("score") * F.col(weight)).alias("x"))
        return self.zero.unionByName(sent).groupBy("v").agg(F.sum("x").alias("x"))


def pagerank(graph: Graph, iterations: int = 10, epsilon: float = 0.0) -> DataFrame:
    """(v, score): starts at 1/V, base (1-d)/V, nothing is passed on for vertices without out-edges.

    Stops early once the scores' total change is below ``epsilon``.
    """
    n, work, kept = graph.vertex_count, Workspace(graph.spark, "pagerank"), _Kept(graph)
    scores = graph.vertices().select("v", F.lit(1.0 / n if n else 0.0).alias("score"))
    for i in range(1, iterations + 1):
        following = kept.incoming(scores, "share").select("v", (F.lit((1 - DAMPING) / n if n else 0.0) + DAMPING * F.col("x")).alias("score"))
        if epsilon > 0:
            following = work.save(following)
            change = following.join(scores.withColumnRenamed("score", "before"), "v").agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0]
            scores = following
            if (change or 0.0) < epsilon:
                break
        else:
            scores = work.save(following) if i % SAVE_EVERY == 0 or i == iterations else following
    kept.edges.release()
    return scores


def pagerank_push(graph: Graph, iterations: int = 10) -> DataFrame:
    """(v, score) of the recurrence without normalisation: starts at 0.15 where an edge leaves (else 0), passed on
    whole the first time and by degree afterwards; the last iteration keeps 0.15 + 0.85 r undivided."""
    work, kept = Workspace(graph.spark, "pagerank"), _Kept(graph)
    scores = kept.has_out.select("v", F.lit(0.15).alias("score"))
    weight = "times"  # the start is not divided by degree
    for i in range(1, iterations + 1):
        scores = kept.incoming(scores, weight).select("v", (F.lit(0.15) + DAMPING * F.col("x")).alias("score"))
        weight = "share"
        if i % SAVE_EVERY == 0 or i == iterations:
            scores = work.save(scores)
    kept.edges.release()
    return scores


#: Scores of up to this number of vertices go to every task.
PULLED_VERTICES = 4_000_000


def pagerank_pull(graph: Graph, iterations: int = 10) -> DataFrame:
    """The same recurrence, read by the targets: in-edges stay partitioned by target, and each vertex gathers its sources' scores.

    Only the scores move, as a broadcast, and sums by target need no shuffle. Beyond ``PULLED_VERTICES`` the scores
    are no longer small, and they are pushed along the edges instead.
    """
    if graph.vertex_count > PULLED_VERTICES or not iterations:
        return pagerank_push(graph, iterations)
    work = Workspace(graph.spark, "pagerank")
    degrees = out_degrees(graph).where("degree > 0")
    pairs = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("times"))
    # Every vertex has a row, so that those without in-edges gather nothing.
    own = graph.vertices().select(F.lit(-1).cast("long").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("long").alias("times"))
    into = pairs.unionByName(own).repartition(F.col("dst")).persist(StorageLevel.MEMORY_AND_DISK)
    sent = degrees.select(F.col("v").alias("src"), F.lit(0.15).alias("sent"))  # the start is not divided by degree
    for _ in range(iterations):
        gathered = into.join(F.broadcast(sent), "src", "left").groupBy("dst").agg(F.sum(F.col("times") * F.coalesce("sent", F.lit(0.0))).alias("x"))
        scores = work.save(gathered.select(F.col("dst").alias("v"), (F.lit(0.15) + DAMPING * F.col("x")).alias("score")))
        sent = scores.join(degrees, "v").select(F.col("v").alias("src"), (F.col("score") / F.col("degree")).alias("sent"))
    into.unpersist()
    return scores


def rank_report(scores: DataFrame, first: int = 5) -> DataFrame:
    """(what, v, score): the first vertices, and the best (the smallest id of equal ones)."""
    best = scores.orderBy(F.desc("score"), "v").limit(1).select(F.lit("max").alias("what"), "v", "score")
    return scores.where(F.col("v") < first).select(F.lit("first").alias("what"), "v", "score").unionByName(best)

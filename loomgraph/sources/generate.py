"""Graphs made by rule: toys with known answers, and random ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.scalar import int_div


def chain(spark: SparkSession, n: int) -> DataFrame:
    """i to i+1 for i < n."""
    return spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def cliques(spark: SparkSession, size: int, copies: int = 1, acyclic: bool = False) -> DataFrame:
    """Disjoint cliques; both directions of each pair, or only upwards."""
    cells = spark.range(copies * size * size)
    base, cell = int_div(F.col("id"), size * size) * size, F.col("id") % (size * size)
    i, j = int_div(cell, size), cell % size
    return cells.where(i < j if acyclic else i != j).select((base + i).alias("src"), (base + j).alias("dst"))


def binary_tree(spark: SparkSession, inner: int) -> DataFrame:
    """i to 2i and 2i+1 for i < inner; 0 has a self-loop."""
    return spark.range(inner).select(F.col("id").alias("src"), F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("dst"))


def batch_circle(spark: SparkSession, size: int, batches: int) -> DataFrame:
    """A ring of cliques; each vertex also points to all of the next clique."""
    cells = spark.range(batches * size * size * 2)
    b, cell = int_div(F.col("id"), 2 * size * size), F.col("id") % (2 * size * size)
    i, j = int_div(cell, 2 * size), cell % (2 * size)
    target = F.when(j < size, b * size + j).otherwise(((b + 1) % batches) * size + j - size)
    return cells.where((j >= size) | (i != j)).select((b * size + i).alias("src"), target.alias("dst"))


def self_loops(spark: SparkSession, n: int, times: int) -> DataFrame:
    return spark.range(n * times).select(int_div(F.col("id"), times).alias("src"), int_div(F.col("id"), times).alias("dst"))


def random_edges(spark: SparkSession, vertices: int, edges: int, seed: int = 0) -> DataFrame:
    """Both ends uniform: the first 15 hex digits of the MD5 of "seed:edge:end" modulo the vertices, the same everywhere."""
    digest = lambda k: F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(f":{k}")).cast("binary"))
    end = lambda k: F.conv(F.substring(digest(k), 1, 15), 16, 10).cast("long") % vertices
    return spark.range(edges).select(end(0).alias("src"), end(1).alias("dst"))


def permutation(spark: SparkSession, first: int, end: int, seed: int = 0) -> DataFrame:
    """(v) of [first, end) in random order."""
    return spark.range(first, end).select(F.col("id").alias("v")).orderBy(F.rand(seed))

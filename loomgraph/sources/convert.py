"""Edge lists to and from text, CSR tables, sorted and shuffled copies."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomgraph.functions.scalar import int_div, low_bits
from loomgraph.operators.access import out_degrees
from loomgraph.operators.dispatch import prefix_sums
from loomgraph.operators.graph import Graph
from loomgraph.plans.workspace import Workspace
from loomgraph.sources.binary import write_words


def parse_edges(lines: DataFrame, skip_header: int = 0, line: str | None = None) -> DataFrame:
    """Edges of text lines: two integers at the start, whatever follows; other lines are skipped.

    ``line`` names a column with line numbers from 0, needed to skip a header.
    """
    rows = lines.where(F.col(line) >= skip_header) if skip_header and line else lines
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract(value, '^\\\\s*([0-9]+)\\\\s+([0-9]+)', {k}), '') AS bigint)")
    return rows.select(number(1).alias("src"), number(2).alias("dst")).dropna(subset=["src", "dst"])


def read_text(spark: SparkSession, path: str, skip_header: int = 0) -> DataFrame:
    """Edges of text files; a header is the first lines of each file."""
    if not skip_header:
        return parse_edges(spark.read.text(path))
    # Only each file's first split can hold header lines, so only its lines are numbered.
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.where("file_block_start = 0").withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("at")) - 1)
    return parse_edges(first, skip_header, "n").unionByName(parse_edges(lines.where("file_block_start > 0")))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(value): "src dst" of each edge."""
    return edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def write_text(edges: DataFrame, path: str) -> None:
    edge_lines(edges).write.mode("overwrite").text(path)


def truncated(edges: DataFrame, bits: int = 32) -> DataFrame:
    """Ids modulo 2 ** bits."""
    return edges.select(low_bits(F.col("src"), bits).alias("src"), low_bits(F.col("dst"), bits).alias("dst"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by (src, dst), of any size."""
    return edges.orderBy("src", "dst")


def shuffled_edges(edges: DataFrame, seed: int = 0) -> DataFrame:
    return edges.orderBy(F.rand(seed))


def csr_offsets(graph: Graph, every: int = 1) -> DataFrame:
    """(v, degree, first): where each vertex's targets start in the adjacency file; every n-th vertex."""
    known = prefix_sums(out_degrees(graph), "v", "degree", top=graph.vertex_count).withColumnRenamed("sum_before", "first")
    return known.where(F.col("v") % every == 0) if every > 1 else known


def csr_adjacency(edges: DataFrame) -> DataFrame:
    """(v, place, dst): all targets by source and target; place is that in the adjacency file.

    The sorted table is written once with each row's place in its part; the parts' sizes (one number
    each) give the rest. A hot source spreads over parts like any other range of rows.
    """
    work = Workspace(edges.sparkSession, "csr")
    parts = edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    at = F.monotonically_increasing_id()
    rows = work.save(parts.select("src", "dst", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))
    return rows.join(F.broadcast(bases), "part").select(F.col("src").alias("v"), (F.col("base") + F.col("at")).alias("place"), "dst")


def write_csr(graph: Graph, path: str) -> None:
    """The graph as ``path/index`` and ``path/adj``, of any size: each file is its folder's parts in the order of their names.

    Both are written as 32-bit words at known places (see csr_index_bytes and adjacency_bytes), sorted by ranges of places.
    """
    spark, n, edges = graph.spark, graph.vertex_count, graph.edge_count
    offsets = -(-n // 16)
    head = -(-(32 + 8 * offsets) // 64) * 16  # words before the degrees
    low, high = (lambda c: low_bits(c, 32)), (lambda c: F.shiftrightunsigned(c, 32))
    words = lambda place, value: [F.struct((place + k).alias("place"), half(value).alias("value")) for k, half in enumerate((low, high))]
    constants = spark.createDataFrame([(0, 0), (2, 0), (4, n), (6, edges)], "p long, x long")
    starts = csr_offsets(graph, 16).select((8 + 2 * int_div(F.col("v"), 16)).alias("p"), F.col("first").alias("x"))
    wide = constants.unionByName(starts).select(F.explode(F.array(*words(F.col("p"), F.col("x")))).alias("w")).select("w.place", "w.value")
    degrees = out_degrees(graph).select((F.col("v") + head).alias("place"), F.col("degree").alias("value"))
    zeros = lambda a, b: spark.range(a, b).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("value"))
    index = wide.unionByName(degrees).unionByName(zeros(8 + 2 * offsets, head)).unionByName(zeros(head + n, head + 16 * offsets))
    ends = spark.range(edges, -(-edges // 1024) * 1024).select(F.col("id").alias("place"), F.lit(0xFFFFFFFF).alias("value"))
    adjacency = csr_adjacency(graph.edges).select("place", F.col("dst").alias("value")).unionByName(ends)
    for name, table in (("index", index), ("adj", adjacency)):
        write_words(table.repartitionByRange("place").sortWithinPartitions("place").select("value"), f"{path}/{name}")


def csr_index_bytes(degrees: list[int], edges: int) -> bytes:
    """The index file of a small graph: four 64-bit words, an offset for every 16 vertices, padding to 64 bytes, 32-bit
    degrees, 64 bytes for every 16 vertices."""
    offsets, total = [], 0
    for v, d in enumerate(degrees):
        if v % 16 == 0:
            offsets.append(total)
        total += d
    head = struct.pack(f"<4Q{len(offsets)}Q", 0, 0, len(degrees), edges, *offsets)
    body = struct.pack(f"<{len(degrees)}I", *degrees)
    return head + b"\0" * (-len(head) % 64) + body.ljust(64 * len(offsets), b"\0")


def adjacency_bytes(targets: list[int]) -> bytes:
    """The adjacency file of a small graph: 32-bit targets, padded with 0xFF to 4096 bytes."""
    raw = struct.pack(f"<{len(targets)}I", *targets)
    return raw + b"\xff" * (-len(raw) % 4096)

"""How edges are dealt to partitions and batches, and how evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.scalar import int_div
from loomgraph.operators.graph import reverse
from loomgraph.plans.workspace import Workspace


def range_partition(v: Column, width: int) -> Column:
    """The partition of a vertex, by ranges of ``width`` ids."""
    return int_div(v, width)


def bucket_shift(vertices: int, buckets: int) -> int:
    """Bits to drop so that ``vertices`` ids fall into at most ``buckets`` buckets of equal power-of-two width."""
    return (max(1, -(-vertices // buckets)) - 1).bit_length()


def bucket(v: Column, first: int, vertices: int, buckets: int) -> Column:
    return F.shiftright(v - F.lit(first), bucket_shift(vertices, buckets))


def dispatch_by_shift(edges: DataFrame, width: int, partitions: int) -> DataFrame:
    """(partition, edges): both ends of each edge are dealt by their high bits, wrapped into the partitions."""
    bits = width.bit_length() - 1
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.groupBy((F.shiftright("v", bits) % partitions).alias("partition")).agg(F.count("*").alias("edges"))


def arrival_batches(edges: DataFrame, arrival: list[str], size: int = 1 << 16) -> DataFrame:
    """(src, dst, batch): runs of ``size`` consecutive edges in the order of the arrival columns.

    The order is found by ranges: the sorted table is written once with each row's place in its part, and the parts'
    sizes (one number each) give the rest.
    """
    work = Workspace(edges.sparkSession, "arrival")
    at = F.monotonically_increasing_id()
    rows = work.save(
        edges.repartitionByRange(*arrival).sortWithinPartitions(*arrival)
        .select("src", "dst", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(F.broadcast(sizes.select("part", before.alias("base"))), "part")
    return numbered.select("src", "dst", int_div(F.col("base") + F.col("at"), size).alias("batch"))


def sorted_batches(batched: DataFrame) -> DataFrame:
    """(batch, side, place, src, dst): each batch's edges, and its reversed edges, by (src, dst), places from 0."""
    sides = batched.withColumn("side", F.lit("out")).unionByName(reverse(batched).withColumn("side", F.lit("in")))
    place = F.row_number().over(Window.partitionBy("batch", "side").orderBy("src", "dst")) - 1
    return sides.select("batch", "side", place.cast("long").alias("place"), "src", "dst")


def greedy_loads(sizes: Column, workers: int) -> Column:
    """Loads after each size in turn goes to the least loaded worker, the first of equal ones."""
    start = F.array_repeat(F.lit(0).cast("long"), workers)

    def give(loads: Column, n: Column) -> Column:
        least = F.array_position(loads, F.array_min(loads))
        return F.transform(loads, lambda x, i: F.when(i + 1 == least, x + n).otherwise(x))

    return F.aggregate(sizes, start, give)


def work_imbalance(batched: DataFrame, width: int, partitions: int, workers: int) -> DataFrame:
    """(batch, ratio, utilisation): largest over mean load, and mean of load over largest, when a batch's
    range partitions go to workers greedily in order."""
    counts = batched.groupBy("batch", range_partition(F.col("src"), width).alias("p")).agg(F.count("*").alias("n"))
    zero = F.transform(F.sequence(F.lit(0), F.lit(partitions - 1)), lambda i: F.lit(0).cast("long"))
    # A batch has at most ``partitions`` counts, whatever its edges.
    sizes = counts.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m")).select(
        "batch", F.transform(zero, lambda z, i: F.coalesce(F.try_element_at("m", i.cast("long")), z)).alias("sizes")
    )
    loads = sizes.select("batch", greedy_loads(F.col("sizes"), workers).alias("loads"))
    total = F.aggregate("loads", F.lit(0).cast("long"), lambda a, x: a + x)
    top = F.array_max("loads")
    return loads.select("batch", (top / (total / workers)).alias("ratio"), (total / top / workers).alias("utilisation"))


def prefix_sums(values: DataFrame, key: str, value: str, blocks: int = 1024, top: int | None = None) -> DataFrame:
    """(key, value, sum_before): the sum over smaller keys, in two levels: within blocks of keys and over blocks."""
    width = max(1, -(-(top if top is not None else (values.agg(F.max(key)).first()[0] or 0) + 1) // blocks))
    known = values.withColumn("_block", int_div(F.col(key), width))
    sums = known.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.withColumn("_within", within).join(F.broadcast(before), "_block").select(key, value, (F.col("_base") + F.col("_within")).alias("sum_before"))


def group_index(keys: DataFrame, key: str, domain: int) -> DataFrame:
    """(key, end): where each key of 0..domain-1 ends in the sorted list of keys."""
    counts = keys.groupBy(key).agg(F.count("*").alias("n"))
    all_keys = keys.sparkSession.range(domain).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n"))
    full = all_keys.unionByName(counts.where(F.col(key).between(0, domain - 1)).select(F.col(key).cast("long").alias(key), "n")).groupBy(key).agg(F.sum("n").alias("n"))
    return prefix_sums(full, key, "n", top=domain).select(key, (F.col("sum_before") + F.col("n")).alias("end"))

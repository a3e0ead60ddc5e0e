"""Measurements printed by experiments: parsing, pivoting, trimmed means, comparisons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TAG = "[EXPOUT]"


def parse_results(lines: DataFrame, tag: str = TAG) -> DataFrame:
    """(key, num, list, str) of the lines with the tag: ``[EXPOUT]Key name: value``.

    Keys are in snake case. ``num`` is the value's first number, ``list`` the numbers of a bracketed value.
    """
    rest = F.substring_index("value", tag, -1)
    key = F.regexp_replace(F.lower(F.trim(F.substring_index(rest, ":", 1))), "[^a-z0-9]+", "_")
    text = F.trim(F.regexp_replace(rest, "^[^:]*:", ""))
    listed = text.rlike(r"^\[.*\]$")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return lines.where(F.instr("value", tag) > 0).where(F.instr(rest, ":") > 0).select(
        key.alias("key"), F.when(~listed, F.try_element_at(numbers, F.lit(1))).alias("num"), F.when(listed, numbers).alias("list"), text.alias("str")
    )


def pivot(frame: DataFrame, row: str, column: str, value: str, columns: list | None = None, how: str = "first") -> DataFrame:
    """One row for each ``row``, one column for each ``column``; repeats by ``how``: first (smallest), mean, list."""
    of = {"first": F.min(value), "mean": F.avg(value), "list": F.sort_array(F.collect_list(value))}[how]
    return frame.groupBy(row).pivot(column, columns).agg(of)


def aggregate_frames(frames: list[DataFrame], keys: list[str], aggregate: Callable[[Column], Column]) -> DataFrame:
    """One frame from several of equal columns: each value is the aggregate of those with equal keys."""
    together = reduce(DataFrame.unionByName, frames)
    return together.groupBy(*keys).agg(*(aggregate(F.col(c)).alias(c) for c in together.columns if c not in keys))


def trimmed_means(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean) of each group: the mean without NaN; of four values or more, of those within 1.5
    quartile ranges of the quartiles. A group without values gets NaN."""
    finite = F.when(~F.isnan(value), F.col(value))
    quartiles = frame.groupBy(*keys).agg(F.count(finite).alias("_n"), F.percentile(finite, [0.25, 0.75]).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    inside = (F.col("_n") < 4) | F.col(value).between(low - 1.5 * (high - low), high + 1.5 * (high - low))
    kept = frame.join(quartiles, keys).where(inside & ~F.isnan(value))
    means = kept.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return quartiles.select(*keys).join(means, keys, "left").withColumn("mean", F.coalesce("mean", F.lit(float("nan"))))


def throughput(frame: DataFrame, edges: str = "edges", seconds: str = "seconds") -> DataFrame:
    """Adds million edges a second."""
    return frame.withColumn("meps", F.col(edges) / F.col(seconds) / 1e6)


def normalise(frame: DataFrame, key: str, value: str, baseline, by: list[str]) -> DataFrame:
    """Adds the value relative to that of the row with ``key`` = ``baseline`` among those with equal ``by``."""
    base = frame.where(F.col(key) == baseline).select(*by, F.col(value).alias("_base"))
    return frame.join(base, by, "left").withColumn("relative", F.col(value) / F.col("_base")).drop("_base")


def memory_table(frame: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Bytes as GB, one column for each system, and which system needs least."""
    wide = pivot(frame.withColumn(value, F.col(value) / 1e9), row, column, value, columns)
    least = F.array_min(F.array(*(F.struct(F.col(c).alias("x"), F.lit(c).alias("n")) for c in columns)))["n"]
    return wide.withColumn("least", least)


def miss_ratios(frame: DataFrame) -> DataFrame:
    """Adds cache misses over references at both levels."""
    return frame.withColumn("l2_ratio", F.col("l2_misses") / F.col("l2_references")).withColumn("llc_ratio", F.col("llc_misses") / F.col("llc_references"))


def latest_files(files: DataFrame, n: int) -> DataFrame:
    """(path, modificationTime) of the n newest, of a ``binaryFile`` listing of a folder; no content is read."""
    return files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(n)

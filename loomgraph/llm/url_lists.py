"""URL filters whose lists change over time.

List entries are dated: a pattern is added to a list on one day and removed on another. Per list and
pattern they become validity intervals, from an addition up to the next entry. A capture is judged by
the entries in force when it was fetched: the as-of join is an equality join on the keys that a URL can
match, followed by the interval test. At most one interval of a list and pattern holds at a time.

Patterns are of three kinds: ``host`` (that host only), ``domain`` (the host and all below it), and
``prefix`` (host and path, at a segment's end). Of the entries in force the longest pattern decides, of
equally long ones an allow list, then the first list by name. No entry in force: not blocked.

Entries with a null field, and actions other than add and remove, are void; of several on one day a
removal counts. Captures with a null URL, none that parses, or a null date match nothing. Repeated
captures are judged one by one; other columns of the captures are ignored. Without captures there are no rows,
without entries nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.plans.workspace import Workspace

#: Lists of up to this many intervals go to every task; larger ones are joined by shuffling, with hot keys in parts.
BROADCAST_INTERVALS = 10_000
#: A key is hot that more captures have than this, and than a ten-thousandth of what such keys have in all.
HOT_ROWS = 100_000


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/+$", "")


def match_keys(host: Column, path: Column) -> Column:
    """Every kind and pattern that a URL matches, joined by a colon."""
    labels, segments = F.split(host, r"\."), F.split(F.concat(host, path), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("prefix:"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, allow, key, pattern, valid_from, valid_to) from (list, allow, kind, pattern, action, day)."""
    sound = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "allow", "kind", "pattern", "day"])
    dated = sound.groupBy("list", "kind", "pattern", "day").agg(F.max("action").alias("action"), F.max("allow").alias("allow"))
    following = F.lead("day").over(Window.partitionBy("list", "kind", "pattern").orderBy("day"))
    return (
        dated.withColumn("valid_to", following).where("action = 'add'")
        .select("list", "allow", F.concat_ws(":", "kind", "pattern").alias("key"), "pattern", F.col("day").alias("valid_from"), "valid_to")
    )


def _hot_keys(keys: DataFrame, work: Workspace) -> DataFrame:
    """(key, _parts) of the hot keys, at most 10,000: in how many parts their rows go."""
    many = work.save(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS))
    limit = max(HOT_ROWS, (many.agg(F.sum("rows")).first()[0] or 0) // 10_000)
    return many.where(F.col("rows") > limit).select("key", F.ceil(F.col("rows") / limit).cast("long").alias("_parts"))


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """id, url, fetched, n_rules, rules (all in force, sorted), decided_by, blocked of every capture."""
    spark = captures.sparkSession
    work = Workspace(spark, "url-lists")
    seen = work.save(captures.select(F.col(id_col), F.col(url_col), F.col(day_col)).withColumn("_row", F.monotonically_increasing_id()))
    intervals = work.save(validity_intervals(entries))
    host = url_host(F.col(url_col))
    keys = (
        seen.where(host.isNotNull() & F.col(day_col).isNotNull())
        .select("_row", F.col(day_col).alias("_day"), F.explode(F.array_distinct(match_keys(host, url_path(F.col(url_col))))).alias("key"))
    )
    if intervals.count() <= BROADCAST_INTERVALS:
        pairs = keys.join(F.broadcast(intervals), "key")
    else:
        hot = F.broadcast(_hot_keys(keys, work))
        parts = F.coalesce("_parts", F.lit(1).cast("long"))
        dealt = keys.join(hot, "key", "left").withColumn("_part", F.pmod(F.xxhash64("_row"), parts)).drop("_parts")
        spread = intervals.join(hot, "key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
        pairs = dealt.join(spread, ["key", "_part"])
    active = pairs.where((F.col("valid_from") <= F.col("_day")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    rule = F.concat_ws("|", "list", "key", F.date_format("valid_from", "yyyy-MM-dd"))
    order = F.struct(-F.length("pattern"), ~F.col("allow"), "list", "key")
    judged = active.groupBy("_row").agg(
        F.count("*").alias("n_rules"), F.array_sort(F.collect_list(rule)).alias("rules"),
        F.min_by(F.struct(rule.alias("rule"), "allow"), order).alias("first"),
    )
    return seen.join(judged, "_row", "left").select(
        id_col, url_col, day_col, F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.array_join(F.coalesce("rules", F.array()), ",").alias("rules"),
        F.col("first.rule").alias("decided_by"), F.coalesce(~F.col("first.allow"), F.lit(False)).alias("blocked"),
    )

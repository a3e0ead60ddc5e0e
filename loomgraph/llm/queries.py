"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens; null and empty texts are an end id alone."""
    from loomgraph.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the two thirds that are not held out; ``und`` without a letter."""
    from loomgraph.llm.langid import hash_fold, identify, sample_labelled, train

    docs = table(spark, sf_dir, "documents")
    model = train(*sample_labelled(docs, hash_fold(F.col("doc_id")) != 1))
    found = identify(docs, model)
    return found.select("doc_id", (hash_fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and how many mentions were replaced."""
    from loomgraph.llm.pii import replace_personal_data

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_personal_data(docs, secret="loomgraph example key", count_col="n_replaced")


# The lists that op4 judges by, besides the hosts' own entries.
URL_LISTS = [
    ("spam", False, "domain", "spam-farm.example.org", "add", "2024-01-01"),
    ("spam", False, "domain", "example.net", "add", "2024-03-01"),
    ("spam", False, "domain", "example.net", "remove", "2024-05-01"),
    ("spam", False, "domain", "example.net", "add", "2024-10-01"),
    ("adult", False, "prefix", "spam-farm.example.org/en", "add", "2024-02-15"),
    ("adult", False, "prefix", "spam-farm.example.org/en", "remove", "2024-08-15"),
    ("trusted", True, "domain", "org", "add", "2024-04-01"),
    ("trusted", True, "host", "spam-farm.example.org", "add", "2024-06-01"),
    ("trusted", True, "host", "spam-farm.example.org", "remove", "2024-06-20"),
]


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, fetched over 2024 by their ids, judged by fixed lists and by one that holds every second host for a while."""
    from loomgraph.llm.url_lists import judge_captures, url_host

    start = F.to_date(F.lit("2024-01-01"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(start, (F.col("page_id") % 365).cast("int")).alias("fetched"))
    hosts = pages.select(url_host(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    added = F.date_add(start, F.length("pattern") * 7)
    own = hosts.select(
        F.lit("watch").alias("list"), F.lit(False).alias("allow"), F.lit("host").alias("kind"), "pattern",
        F.explode(F.array(F.struct(F.lit("add").alias("action"), added.alias("day")), F.struct(F.lit("remove").alias("action"), F.date_add(added, 90).alias("day")))).alias("e"),
    ).select("list", "allow", "kind", "pattern", "e.action", "e.day").where("length(pattern) % 2 = 0")
    fixed = spark.createDataFrame(URL_LISTS, "list string, allow boolean, kind string, pattern string, action string, day string").withColumn("day", F.to_date("day"))
    judged = judge_captures(pages, fixed.unionByName(own))
    return judged.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


_FIXED_ROWS = ", ".join(f"('{a}', {str(b).lower()}, '{c}', '{d}', '{e}', DATE '{f}')" for a, b, c, d, e, f in URL_LISTS)
OP4_SQL = f"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
         rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS path
  FROM pages
), hosts AS (
  SELECT DISTINCT host AS pattern FROM captures WHERE length(host) % 2 = 0
), entries AS (
  SELECT * FROM (VALUES {_FIXED_ROWS}) AS f(list, allow, kind, pattern, action, day)
  UNION ALL
  SELECT 'watch', false, 'host', pattern, 'add', DATE '2024-01-01' + CAST(length(pattern) * 7 AS INTEGER) FROM hosts
  UNION ALL
  SELECT 'watch', false, 'host', pattern, 'remove', DATE '2024-01-01' + CAST(length(pattern) * 7 + 90 AS INTEGER) FROM hosts
), intervals AS (
  SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS valid_to FROM entries
), matched AS (
  SELECT c.page_id, i.list || '|' || i.kind || ':' || i.pattern || '|' || strftime(i.day, '%Y-%m-%d') AS rule, i.allow,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.pattern) DESC, NOT i.allow, i.list, i.kind || ':' || i.pattern) AS place
  FROM captures c JOIN intervals i
    ON i.action = 'add' AND i.day <= c.fetched AND (i.valid_to IS NULL OR c.fetched < i.valid_to)
   AND ((i.kind = 'host' AND c.host = i.pattern)
     OR (i.kind = 'domain' AND (c.host = i.pattern OR c.host LIKE '%.' || i.pattern))
     OR (i.kind = 'prefix' AND (c.host || c.path = i.pattern OR c.host || c.path LIKE i.pattern || '/%')))
), judged AS (
  SELECT page_id, count(*) AS n_rules, string_agg(rule, ',' ORDER BY rule) AS rules,
         max(CASE WHEN place = 1 THEN rule END) AS decided_by, max(CASE WHEN place = 1 AND NOT allow THEN 1 ELSE 0 END) = 1 AS blocked
  FROM matched GROUP BY page_id
)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(j.n_rules, 0) AS n_rules, coalesce(j.rules, '') AS rules,
       j.decided_by, coalesce(j.blocked, false) AS blocked
FROM captures c LEFT JOIN judged j USING (page_id)
"""


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates (three words, 0.85); those without words are alone."""
    from loomgraph.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, numerator=85, denominator=100)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to; null texts count as empty."""
    from loomgraph.llm.bpe import encode_digests

    docs = table(spark, sf_dir, "documents")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as WAV files; half of them are declared as PNG, by their content, which sniffing corrects."""
    from loomgraph.llm.media import media_digests, store_texts

    stored = store_texts(table(spark, sf_dir, "documents"), "audio/wav")
    declared = F.when(F.crc32("media") % 2 == 0, "audio/wav").otherwise("image/png")
    return media_digests(stored.withColumn("declared", declared))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9 and its component; null, zero and non-finite vectors are alone."""
    from loomgraph.llm.multi_index import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; null and empty pages have an empty one."""
    from loomgraph.llm.wrapper import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the findings in every text itself, and the spans of those of all layers; null counts as empty."""
    from loomgraph.llm.secrets import KINDS, scan_documents

    found = scan_documents(table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pattern_packing": op1_pattern_packing,
    "op2_language_id": op2_language_id,
    "op3_surrogates": op3_surrogates,
    "op4_url_lists": op4_url_lists,
    "op5_minmax_dedup": op5_minmax_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_media_sniff": op7_media_sniff,
    "op8_multi_index": op8_multi_index,
    "op9_wrapper_text": op9_wrapper_text,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {"op4_url_lists": OP4_SQL}

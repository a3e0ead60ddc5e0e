"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. What it returns is
written as Parquet and read again as the next one's docs; all but the last return the columns of docs.
Empty tables pass through every stage. Null and empty texts go in the first, as no language is found.
"""

from __future__ import annotations

from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.langid import accepted, sample_labelled, train
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.pii import replace_personal_data
from loomgraph.plans.workspace import Workspace

#: The setting that holds the key of the surrogates; Spark hides its value in logs, as its name says what it is.
KEY = "spark.loomgraph.pii.secret"


def quoted(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones.

    Null texts and texts without a letter go. Repeated rows and rows with equal or null ids are judged alike, by their text.
    """
    return accepted(docs, train(*sample_labelled(docs, F.lit(True))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of the smallest id.

    If ids are missing or come again, rows are told apart by numbers of their own, and the first row of a group stays, so
    that different texts of one id all stay, and repeated rows do not. Null and empty texts are in no group and stay.
    """
    unnamed = not docs.where("doc_id is null").isEmpty()
    if not unnamed and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(docs, words=5, numerator=80, denominator=100).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*quoted(docs))
    names = {c.lower() for c in docs.columns}
    row = next(n for n in (f"_row{i}" for i in range(len(names) + 1)) if n not in names)
    numbered = Workspace(spark, "rows").save(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = near_duplicates(numbered, words=5, numerator=80, denominator=100, id_col=row).where("kept").select(row)
    return numbered.join(kept, row, "left_semi").select(*quoted(docs))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in every text, and the column n_chars, if there is one, set to the new length.

    The key is the session's ``spark.loomgraph.pii.secret``. Where none is set, a random one is drawn for the session,
    so that nobody can compute the surrogates of known names. Null texts stay null; repeated rows stay alike.
    """
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, token_hex(32))
    out = replace_personal_data(docs, secret=spark.conf.get(KEY))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens.

    Null texts count as empty. Every row is packed, repeated ones as often as they come; ties go to any place of equal fit.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii_surrogates", pii_surrogates), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir))
    return docs


#: No stage but the filter on duplicates can be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None

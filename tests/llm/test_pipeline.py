"""The registered queries and the pipeline on small tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm import queries
from tests.llm.test_dedup import brute

SF = os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stage_shapes(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii_surrogates", "packing"]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_stage_results(stages):
    (raw, known), (_, single), (_, private), (_, packed) = stages
    assert known.count() >= 0.99 * raw.count()
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in brute(rows, 5, 80, 100).items() if i == c}
    assert private.count() == single.count() and private.where(F.length("text") != F.col("n_chars")).isEmpty()
    assert private.where(F.col("text").rlike(r"@mail[0-9]\.example\.com")).isEmpty()
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in private.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_edges(spark, tmp_path):
    """Odd rows through all four stages."""
    text = "a b c d e f g h i j"
    rows = [(1, text, "en"), (1, text, "en"), (1, "k l m n o p q r s t u v", "en"), (2, None, "en"), (3, "", None), (None, text, "en"), (None, "w x y z " * 5000, "en"), (4, "1 2 3", "de"), (5, "Call +1 (212) 555-0199 now please", "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `x.y` string, kept string, _row0 string, digest string"
    docs = spark.createDataFrame([(*r, "s", 1, "q", "z", "r", "d") for r in rows], schema)
    for name, f in corpus_pipeline.STAGES:
        before = docs.columns
        f(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before
        if name == "near_dedup":  # both texts of one id stay, copies go whatever their ids
            assert sorted(r["text"][:9] for r in docs.collect()) == ["Call +1 (", "a b c d e", "k l m n o", "w x y z w"]
        if name == "pii_surrogates":
            assert "212) 555-0199" not in docs.where("doc_id = 5").first()["text"]
    assert docs.select("doc_id", "piece", "start").count() >= 4
    empty = spark.createDataFrame([], schema)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, "").isEmpty()


def test_key_is_drawn_where_none_is_set(spark):
    docs = spark.createDataFrame([(1, "Mr. Smith")], "doc_id long, text string")
    spark.conf.unset(corpus_pipeline.KEY)
    first, again = (corpus_pipeline.pii_surrogates(spark, docs, "").first()["text"] for _ in "ab")
    spark.conf.unset(corpus_pipeline.KEY)
    other = corpus_pipeline.pii_surrogates(spark, docs, "").first()["text"]
    assert first == again != other and "Smith" not in first


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    tables = {"op8_multi_index": "embeddings", "op9_wrapper_text": "pages", "op4_url_lists": "pages"}
    count = queries.QUERIES[name](spark, SF).count()
    table = spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet").count()
    assert count >= table if name == "op1_pattern_packing" else count == table


def test_op4_against_sql(spark):
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    key = lambda df: sorted((tuple(None if x != x else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert key(queries.QUERIES["op4_url_lists"](spark, SF).toPandas()) == key(con.execute(queries.ORACLES["op4_url_lists"]).df())


def test_registered():
    found = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)

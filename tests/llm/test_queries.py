"""The registered queries of the numbered operators against DuckDB, and the pipeline's stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spikeloom.llm import pii, queries

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    expected = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, df.select(*expected.columns).collect()))) == sorted(map(repr, expected.fetchall()))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).select("*").checkpoint(eager=True)
        assert docs.columns == columns
        seen[name] = docs
    good = labels.filter("quality = 1").count()
    left = seen["quality classifier"].join(labels.filter("quality = 1"), "doc_id").count()
    assert left >= 0.97 * good and seen["quality classifier"].join(labels.filter("quality = 0"), "doc_id").count() <= 0.1 * labels.filter("quality = 0").count() + 1
    texts = seen["personal data"]
    assert texts.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert all(not pii.base_spans(r.text) for r in texts.select("text").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, texts, SF)
    assert packed.filter("piece = 0").count() == texts.count()


def test_odd_rows_go_through(spark):
    """Nulls, repeated rows, a very long text, and columns with the operators' own names."""
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").limit(20).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in good] + [(r.doc_id, r.text) for r in good[:5]] + [(9001, None), (None, good[0].text), (9002, ""), (9003, "\n".join(r.text for r in good) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("score", "key", "line", "kept", "spans", "length", "value")])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF).checkpoint(eager=True)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {None, 9001, 9002} <= ids, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count()
    judged = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert judged.filter("doc_id IS NULL").count() == 1


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

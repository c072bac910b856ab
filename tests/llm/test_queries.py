"""The queries against SQL where there is some, and the pipeline against its stages' plain versions."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from sparkmart.llm import langid, queries, quality

from .helpers import SCHEMA, awkward, empty, frame, words
from .test_substring import brute

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df, want = queries.queries()[name](spark, data), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[k] for k in order) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in SQL])
def test_query_gives_every_row(spark, data, name):
    df = queries.queries()[name](spark, data)
    ids = spark.read.parquet(f"{data}/documents.parquet").count()
    assert df.select("doc_id").distinct().count() == ids


def test_stages(spark):
    docs = frame(spark)
    one = corpus_pipeline.language(spark, docs, "")
    assert one.schema == docs.schema and one.count() == langid.judged(docs, langid.train(docs.where(~langid.held_out())), "text").where("not __rejected").count()
    two = corpus_pipeline.quality_rules(spark, docs, "")
    assert two.schema == docs.schema and two.count() == quality.judged(docs).where("kept").count()
    three = corpus_pipeline.near_dedup(spark, docs, "")
    assert three.schema == docs.schema
    left = {r["doc_id"] for r in three.collect()}
    for k in range(10):
        first, copy = k * 7, 120 + k
        if len(words(awkward()[first][1])) >= 12:
            assert copy not in left
    four = corpus_pipeline.substring_dedup(spark, docs, "")
    assert Counter(len(words(r["text"])) for r in four.collect()) == Counter(n - gone for _, n, gone, _ in brute(awkward()))
    five = corpus_pipeline.packing_bins(spark, docs, "")
    assert five.agg({"n_units": "sum"}).first()[0] == sum(len(words(r[1])) for r in awkward())


def test_run(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "substring_dedup", "packing"]


def test_run_on_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert len(SCHEMA.split(",")) == 5

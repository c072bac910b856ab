"""Which rows of near duplicates the pipeline's stage keeps."""

import corpus_pipeline

from .helpers import frame


def text(k):
    return " ".join(f"t{k}w{i}" for i in range(40))


def test_rows_go_by_their_own_text(spark):
    rows = [(1, text(0), "en", "s", 0), (5, text(0), "en", "s", 0), (5, text(1), "en", "s", 0), (7, text(1), "en", "s", 0), (7, text(2), "en", "s", 0), (8, text(3), "en", "s", 0), (8, text(3), "en", "s", 0)]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, text(0)), (5, text(1)), (7, text(2)), (8, text(3)), (8, text(3))]


def test_rows_without_an_id(spark):
    rows = [(3, text(0), "en", "s", 0), (None, text(0), "en", "s", 0), (None, text(1), "en", "b", 0), (None, text(1), "en", "a", 0), (None, text(1).upper(), "en", "c", 0), (None, text(2), "en", "s", 0)]
    docs = frame(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=str) == sorted([(3, text(0), "s"), (None, text(1).upper(), "c"), (None, text(2), "s")], key=str)

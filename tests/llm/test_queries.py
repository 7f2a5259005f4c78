"""Queries with SQL equal it; the others have brute-force tests of their own."""

import pytest

import __spark_entry__
import corpus_pipeline
from plumbline.llm.queries import oracle_sql, queries
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries()[name], oracle_sql()[name])


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline(spark):
    """Every stage against what it may keep; the last one's pieces against the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = corpus_pipeline.staged(docs, "test")
        assert 0.6 * before < docs.count() <= before
        assert docs.select("doc_id").distinct().count() == docs.count()
    texts = {r["doc_id"] for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == texts
    assert docs.select("text").distinct().count() >= docs.count() - docs.where("text = ''").count()

"""Registered queries on the smallest tables: against their SQL, or for their contract's shape."""

import os

import pytest

import corpus_pipeline
from storelens.llm import queries
from storelens.llm.common import table
from tests import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
ROWS = {"op1": "pages", "op2": "documents", "op3": "embeddings", "op4": "pages", "op6": "documents", "op7": "documents", "op8": "documents", "op9": "documents", "op10": "pages"}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(spark, name):
    assert compare.spark_rows(queries.QUERIES[name](spark, SF)) == compare.duck_rows(compare.connect(SF), queries.SQL[name])


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.split("_")[0] in ROWS])
def test_query_keeps_every_row(spark, name):
    given = table(spark, SF, ROWS[name.split("_")[0]])
    found = queries.QUERIES[name](spark, SF)
    key = given.columns[0]
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in given.select(key).collect())


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert kept.join(docs, docs.columns, "left_anti").count() == 0, name
    # Later stages decide on what the earlier ones kept.
    step = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        step = function(spark, step, SF)
    ids = {r.doc_id for r in step.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_pipeline_takes_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs, SF).count() == 0, name

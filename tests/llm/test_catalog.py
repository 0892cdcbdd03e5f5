"""Every query with SQL against it, and the shape of the pipeline."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tests.llm.cases import SCHEMA
from tests.oracle import compare, duck
from tracewell.llm.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    same, note = compare(con, QUERIES[name](spark, SF), SQL[name])
    assert same, note


def test_pipeline_stages_keep_the_columns_and_the_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in spark.createDataFrame([], SCHEMA).schema], name
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids
        assert len(left) >= len(ids) * 0.8
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(ids)


def test_pipeline_runs_on_awkward_and_empty_tables(spark, tmp_path):
    from tests.llm.cases import awkward, nothing

    for k, docs in enumerate((awkward(spark), nothing(spark))):
        folder = str(tmp_path / f"t{k}")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
        if k:
            assert not out
        else:
            assert {3, 7, None} <= set(out)
            assert 4 not in out or out[4].n_tokens == 0

"""The pipeline's stages in order, and the registered queries against their SQL."""

import os

import pytest

import corpus_pipeline
from checks.compare import compare, connect
from editwarden.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "mixture"]
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(connect(SF), QUERIES[name](spark, SF), SQL[name]) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
def test_pipeline_follows_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        from editwarden.llm.frames import stored
        docs = stored(stage(spark, docs, SF), "test-stage")
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= ids and len(rows) == len({r.doc_id for r in rows})
        ids = {r.doc_id for r in rows}
        if name != "mixture":
            assert docs.columns == columns
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in rows} and got

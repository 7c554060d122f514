import os

import pytest

import corpus_pipeline
from earshot.llm import queries

SF = "/root/testdata/sf0.001"
need = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@need
def test_pipeline_runs_as_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, SF).collect()) and docs.count()


@need
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    from scripts.compare import compare

    assert compare(spark, SF, name, queries.QUERIES[name], queries.ORACLE[name]) == ""

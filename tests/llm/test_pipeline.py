import pytest

import corpus_pipeline
from feedloom.llm import oracle, queries
from tools.compare import connect, difference

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert 0 < docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and before > 0
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, last.collect()))


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    assert difference(spark, connect(SMALL), SMALL, queries.registered()[name], oracle.oracle_sql()[name]) is None

import pytest

from plumbline.llm import queries, stages

from ..oracle import rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows_of_spark(queries.QUERIES[name](spark, sf)) == rows_of_sql(queries.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0 and not [t for _, t in df.dtypes if t == "void"]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in stages.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        rows = after.collect()
        assert {r.doc_id for r in rows} <= ids and len(rows) > 0.4 * len(ids)
        ids = {r.doc_id for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    last = {r.doc_id: r.ids for r in stages.STAGES[-1][1](spark, docs, sf).collect()}
    assert set(last) == ids
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == last

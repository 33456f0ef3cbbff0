import pytest

from plumbline.plans import catalogue

from .oracle import rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows_of_spark(catalogue.QUERIES[name](spark, sf)) == rows_of_sql(catalogue.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_is_steady(spark, sf, name):
    """What these compute is tested elsewhere; here: rows, named columns, and the same rows again from other partitions."""
    first = rows_of_spark(catalogue.QUERIES[name](spark, sf))
    assert first[0] and first[1]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of_spark(catalogue.QUERIES[name](spark, sf)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

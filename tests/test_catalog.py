import pytest
from oracle import agree

from lumenframe.plans import acquisition_queries, behaviour_queries, binning_queries, catalog, fit_queries, hull_queries, image_queries, recording_queries, relation_queries, segment_queries, series_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    agree(spark, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

import pytest
from specloom.plans import page_queries, queries, record_queries  # noqa: F401  they register themselves

from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0

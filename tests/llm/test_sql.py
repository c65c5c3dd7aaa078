"""Queries of the corpus operators against their SQL, on whole tables."""
import pytest

from compare import connect, differences
from rotapanel.llm import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name]) is None


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14))

"""Registered queries against their SQL."""
import pytest

import __spark_entry__ as entry_module
from compare import connect, differences

# Queries of the corpus operators are compared in tests/llm.
OWN = entry_module.load_all()
ORACLES = {name: text for name, text in entry_module.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(entry_module.queries()[name](spark, sf), con, ORACLES[name]) is None


def test_flagship(spark):
    rows = entry_module.entry(spark).collect()
    assert [r.trimestre for r in sorted(rows)] == ["T1", "T2", "T3", "T4"]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry_module.queries())

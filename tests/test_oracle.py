"""Every query with SQL equals it exactly: columns, types, rows."""

import pytest

import __spark_entry__ as registry
from compare_oracle import connect, difference

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert difference(registry.queries()[name](spark, PATH), duck, registry.oracle_sql()[name]) == ""


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_profiles_the_segments(spark):
    rows = registry.entry(spark).collect()
    assert rows and {"segment", "customers"} <= set(rows[0].asDict())

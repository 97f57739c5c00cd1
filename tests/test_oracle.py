"""Every named query beside its SQL, value by value."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect
from vitrine.plans import queries as registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(registry.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


def test_entry_point(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "unidades", "receita", "lucro"]
    assert df.count() == 20

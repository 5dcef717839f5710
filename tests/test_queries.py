"""Every query runs over the smallest tables, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from paperloom.plans import catalog
from tests.oracle_compare import connect, difference

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    assert difference(spark, con, catalog.queries()[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

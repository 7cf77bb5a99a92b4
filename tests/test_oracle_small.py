"""Every registered query with an SQL statement equals DuckDB at sf0.001."""
import os
import sys

import pytest

from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, con, name):
    assert compare(name, E.queries()[name](spark, SF001), SQL[name], con, verbose=True)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 5 + 156

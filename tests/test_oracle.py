"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("match_") and n not in SQL))
def test_matching_without_sql_runs_on_more(spark, name):
    """Strata of every shape: what the smallest tables do not have."""
    df = entry.queries()[name](spark, "/root/testdata/sf0.01")
    assert df.count() > 1000


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())

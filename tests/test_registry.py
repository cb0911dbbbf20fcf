"""Every registered query runs, and equals its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf, name):
    verdict, _, _ = check(spark, con, name, sf)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

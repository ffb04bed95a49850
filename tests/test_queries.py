"""Every registered query against its SQL, on whole tables."""

import pytest
from checks import database, rows_of

import __spark_entry__ as entry_points
from pulseline.plans.catalogue import QUERIES

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, folder, con, name):
    got = entry_points.queries()[name](spark, folder).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["event_type", "window_start", "window_end", "n"]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) and set(QUERIES) <= set(entry_points.queries())

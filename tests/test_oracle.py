"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import ROOT, connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from velometric.plans.catalog import QUERIES

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert difference(spark, con, FOLDER, queries()[name], oracle_sql()[name]) is None


def test_station_hist_whole_is_in_order(spark):
    rows = [(r["id"], r["name"]) for r in queries()["station_hist_whole"](spark, FOLDER).collect()]
    assert len(rows) > 40 and rows == sorted(rows)


def test_entry(spark):
    assert entry(spark).count() > 0

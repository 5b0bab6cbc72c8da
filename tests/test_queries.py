"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from stagecraft.queries.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
NAMES = list(queries())


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, text = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(NAMES)


def test_flagship(spark):
    assert entry(spark).count() > 0

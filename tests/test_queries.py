"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import SMALLEST, entry, oracle_sql, queries
from compare import compare, duck
from dbgauge.plans import all_oracles, all_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    return duck(SMALLEST)


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())


def test_registered_queries():
    assert set(all_queries()) <= set(queries()) and set(all_oracles()) <= set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, all_queries()[name], all_oracles()[name], SMALLEST) is None

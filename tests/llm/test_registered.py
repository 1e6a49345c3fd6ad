"""Every registered query of the subpackage on the smallest tables: beside its SQL where there is some, else for its rows."""

import pytest
from compare import compare, duck

from __spark_entry__ import SMALLEST, oracle_sql, queries
from dbgauge.llm.queries import QUERIES

NAMES = [*QUERIES, "pipeline"]


def test_all_are_registered():
    assert len(NAMES) == 14 and set(NAMES) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(spark, duck(SMALLEST), name, queries()[name], oracle_sql().get(name), SMALLEST) is None

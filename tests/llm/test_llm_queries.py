"""Every query on training texts runs on the smallest data."""

import pytest

import __spark_entry__ as entry
from commitloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())

"""Every registered query against its SQL twin."""

from __future__ import annotations

import importlib
import os

import pytest

import comparison

ENTRY = importlib.import_module("__spark_entry__")
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = ENTRY.queries()
SQL = ENTRY.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return comparison.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert comparison.differences(result, con, SQL[name]) == []
    else:
        assert result.count() > 0

"""Every registered query against its DuckDB counterpart on the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
# Reports whose answer is legitimately without rows on this scale.
MAY_BE_EMPTY = {"eviction_counts", "stream_throughput", "hot_throughput_1h", "hot_throughput_24h_target"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    found = difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert found is None or (found == "EMPTY" and name in MAY_BE_EMPTY), found


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

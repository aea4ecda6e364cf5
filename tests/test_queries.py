"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_query_has_a_counterpart():
    for group in entry.CORE:
        assert set(group.QUERIES) == set(group.SQL)


def test_entry_gives_one_row_per_store(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_matches_sql(spark, db, name):
    ok, note = compare(spark, db, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert ok, note

"""Registered queries against their SQL on the smallest data set.

The maintained and streamed ones have suites of their own; ``compare.py`` runs all.
"""

import pytest

import __spark_entry__ as entry
from mastline.registered import QUERIES
from tests.compare import compare, database

SF = "/root/testdata/sf0.001"
_SLOW = ("incremental_", "stream_", "refresh_", "verify_mismatches", "ingest_", "affected_", "qualifying_", "tag_transitions")


@pytest.fixture(scope="module")
def connection():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(_SLOW)])
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10

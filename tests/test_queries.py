"""Every named query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from mailgrain.plans import catalog
from tests.compare import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, SF_DIR, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_emails"] == 200

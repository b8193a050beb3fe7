"""Every query with SQL agrees with it, on the smallest tables; names and schemas are as the driver expects."""

import pytest
from check_oracle import compare

import __spark_entry__ as entry
from tidewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, SF) == ""


def test_every_catalog_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())

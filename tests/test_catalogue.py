"""Every registered query runs, and equals its SQL in names, rows and values."""

import pytest

import __spark_entry__ as entry
from sparkwright import catalogue
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = spark_rows(catalogue.QUERIES[name](spark, sf))
    if name in catalogue.ORACLES:
        assert got == duck_rows(duck, catalogue.ORACLES[name])
    else:
        assert got[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

import pytest

from tessella import catalog
from tests.oracle import both

import __spark_entry__ as entry


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, sf, name):
    mine, theirs = both(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])
    assert mine == theirs

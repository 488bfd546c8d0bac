"""Every relational query against its SQL."""

import pytest
from oracle import oracle_rows, spark_rows

from sedimenta.plans import bindings


def test_every_operator_has_sql():
    assert set(bindings.QUERIES) == set(bindings.ORACLE_SQL)
    assert len(bindings.QUERIES) >= 85


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, sf, name):
    found = spark_rows(bindings.QUERIES[name](spark, sf))
    assert found == oracle_rows(bindings.ORACLE_SQL[name], sf)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1

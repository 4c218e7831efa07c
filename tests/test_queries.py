"""Every query of the catalogue: equal to its SQL, or at least it runs and has rows."""

import pytest
from oracle import SF, compare

from sparsewright.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
#: Queries with no row on the smallest tables.
EMPTY = {"j6_ids_without_entries"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name]) > 0 or name in EMPTY


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert QUERIES.keys() <= e.queries().keys() and SQL.keys() <= e.oracle_sql().keys() <= e.queries().keys()

"""Every registered query against its SQL counterpart on the smallest tables."""

import __spark_entry__ as entry_points
import pytest
from compare import connect, difference

from scriptgauge.plans import catalog

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    assert difference(QUERIES[name](spark, small), con, SQL[name]) == ""


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 30 and rows[0].asDict().keys() == {"dialect", "rn", "unit_id", "score"}

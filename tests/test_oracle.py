"""Every query that SQL can express gives the rows of its SQL; the others give rows."""

import pytest

from barloom.plans import registry

from .conftest import DATA
from .oracle import difference

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

"""Every query that has SQL, against DuckDB on the same tables; every other one gives rows."""

import pytest

from tests.compare import connect, difference
from tests.conftest import SMALL
from tidewell.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert difference(registry.queries()[name](spark, SMALL), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).take(1)

import pytest

from tests.helpers import SF, compare, connect
from tremorlab import plans

NAMES = sorted(plans.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_reference_sql(spark, con, name):
    compare(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

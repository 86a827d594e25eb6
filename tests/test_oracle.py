import pytest
from oracle import compare

from hakumei.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    compare(spark, registry.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())

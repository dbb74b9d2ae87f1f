import pytest

from compare import difference
from loomspark import registry

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, registry.QUERIES[name], registry.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_query_runs_and_repeats(spark, name):
    a = registry.QUERIES[name](spark, SMALL)
    assert a.count() > 0
    assert sorted(map(str, a.collect())) == sorted(map(str, registry.QUERIES[name](spark, SMALL).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6000
    assert set(e.oracle_sql()) <= set(e.queries())

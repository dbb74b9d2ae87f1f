import pytest

from loomspark.sources import stored
from loomspark.sources.feature_cache import FeatureCache


@pytest.fixture
def cache(spark, tmp_path):
    return FeatureCache(spark, f"file://{tmp_path}/cache")


def table(spark, *names):
    return spark.createDataFrame([(i, *[f"{n}{i}" for n in names]) for i in range(4)], "k long" + "".join(f", {n} string" for n in names))


def test_a_write_that_dies_leaves_the_table_before(spark, cache):
    first = cache.put("d", ["a"], table(spark, "a"))
    failing = table(spark, "a").selectExpr("k", "if(k = 3, raise_error('lost'), a) as a")
    with pytest.raises(Exception, match="lost"):
        cache.put("d", ["a"], failing)
    assert cache.get("d", ["a"], check_rows=True).count() == 4
    second = cache.put("d", ["a"], table(spark, "a").where("k > 1"))
    assert (first.count(), second.count(), cache.get("d", ["a"], check_rows=True).count()) == (4, 2, 2)  # readers of the first keep it


def test_of_two_writers_the_first_is_kept(spark, cache):
    cache.put("d", ["a"], table(spark, "a"))
    with pytest.raises(stored.Conflict):  # as one who looked before the first was there
        cache._entry("d", ["a"])._commit(0, {})
    assert cache.get("d", ["a"]).count() == 4


def test_only_missing_features_are_built(spark, cache):
    asked = []

    def build(missing):
        asked.append(missing)
        return table(spark, *missing)

    assert cache.get_or_extend("d", ["a", "b"], ["k"], build).columns == ["k", "a", "b"]
    assert cache.get_or_extend("d", ["b", "c", "a"], ["k"], build).columns == ["k", "b", "c", "a"]
    got = cache.get_or_extend("d", ["c", "b"], ["k"], build)
    assert asked == [["a", "b"], ["c"]] and sorted(map(tuple, got.collect())) == [(i, f"c{i}", f"b{i}") for i in range(4)]
    assert cache.sets("d") == [["a", "b", "c"], ["a", "b"], ["b", "c"]] and cache.sets("none") == []
    assert cache.get_or_extend("d", [], ["k"], lambda missing: table(spark)).columns == ["k"]

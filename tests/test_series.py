"""Series in pieces against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import quality, ranking, series, temporal

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def events(spark):
    df = spark.read.parquet(EVENTS).select("event_id", "ts", "user_id", "value")
    # one user has a third of all rows, one key is null, and a third of the values lack
    key = F.when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 50 == 1, None).otherwise(F.col("user_id"))
    return df.withColumns({"user_id": key, "value": F.when(F.col("event_id") % 7 > 1, F.col("value"))}).cache()


def same(a, b):
    a, b = (sorted(map(tuple, x.select(sorted(x.columns)).collect()), key=str) for x in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and p == pytest.approx(q, rel=1e-9, abs=1e-9) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("keys", [["user_id"], []])
def test_long_series_equal_windows(events, keys):
    df = events.where("event_id < 4000")
    for f in (lambda most: temporal.series_features(df, "value", ["ts", "event_id"], keys, (1, 4), (3, 9), True, most), lambda most: quality.impute(df, "value", "fill", ["ts", "event_id"], keys, most), lambda most: quality.impute(df, "value", "interpolate", ["ts", "event_id"], keys, most)):
        same(f(150), f(10**9))


def test_pieces_are_bounded_and_shorter_than_windows(events):
    df = events.where("event_id < 3000")
    rest, hot = series.split(df, ["user_id"], ["ts", "event_id"], 100)
    assert hot.groupBy("user_id", series.PIECE).count().agg(F.max("count")).first()[0] <= 100
    assert rest.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 100
    assert rest.count() + hot.count() == 3000
    tiny = df.where("event_id < 60")  # windows reach over several pieces
    same(temporal.series_features(tiny, "value", ["ts", "event_id"], [], (1, 30), (25,), True, 4), temporal.series_features(tiny, "value", ["ts", "event_id"], [], (1, 30), (25,), True))


def test_running_sums_and_exclusive_ors(events):
    want = {n: f(F.col("event_id")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)) for n, f in (("s", F.sum), ("x", F.bit_xor))}
    same(series.running(events, ["user_id"], ["ts", "event_id"], {"s": F.col("event_id")}, {"x": F.col("event_id")}, most=200), events.withColumns(want))


def test_first_ranks_of_a_frequent_value(events):
    df = events.select("event_id", F.when(F.col("event_id") % 3 > 0, 5.0).otherwise(F.col("event_id") % 10.0).alias("x"))
    same(ranking.ranking_features(df, ["x"], "first", ["event_id"], most=500), ranking.ranking_features(df, ["x"], "first", ["event_id"]))


def test_series_without_rows(events):
    assert temporal.series_features(events.limit(0), "value", ["ts"], [], expanding=True).count() == 0
    with pytest.raises(ValueError, match="unknown way"):
        quality.impute(events, "value", "guess", ["ts"], ["user_id"])

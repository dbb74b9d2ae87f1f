"""Most similar sets and sparse least squares against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import attribution, least_squares, set_search


def closest(rows):
    sets = {r: set(x for x in fs or [] if x is not None) for r, fs, _ in rows}
    out = {}
    for a, x in sets.items():
        best = max(((len(x & y) / len(x | y), -b) for b, y in sets.items() if a != b and x & y), default=None)
        if best:
            out[a] = (-best[1], best[0])
    return out


@pytest.mark.parametrize("frequent", [3, 20, 1000])
def test_closest_sets_with_a_feature_in_every_run(spark, frequent):
    rng = np.random.default_rng(1)
    rows = [(i, ["all", *(f"f{x}" for x in rng.integers(0, 60, rng.integers(0, 7)))], float(i)) for i in range(250)]
    rows += [(1000 + i, ["all", "big", *(f"g{x}" for x in range(i % 3))], 1.0) for i in range(60)] + [(2000, None, 1.0), (2001, [], 1.0), (2002, ["alone"], 1.0), (2003, ["all", None, "all"], 1.0)]
    got = {r.run: (r.other, r.jaccard) for r in attribution.closest_set(spark.createDataFrame(rows, "run long, features array<string>, score double"), frequent=frequent).collect()}
    assert got == closest(rows)


def test_pairs_stay_far_below_all(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("set"), F.array_distinct(F.concat(F.array(F.lit("all")), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("f"), (F.hash("id", i) % 2000).cast("string"))))).alias("fs"))
    ranked = set_search._rarest_first(rows)
    pairs = sum(set_search.similar_pairs(ranked, ranked, num, den).count() for num, den in set_search.STEPS)
    assert pairs < n * n / 100
    assert set_search._by_frequent(ranked, ranked, 1000).count() < n * 20


def test_least_squares_equal_normal_equations(spark):
    rng = np.random.default_rng(2)
    sets = [[f"f{j}" for j in range(12) if rng.random() < 0.3] + (["every"] if i >= 0 else []) for i in range(300)]
    sets = [s + (["twin"] if "f3" in s else []) for s in sets] + [[]]
    y = rng.normal(size=len(sets))
    names = sorted({x for s in sets for x in s})
    a = np.array([[n in s for n in names] for s in sets], float)
    want = np.linalg.lstsq(a - a.mean(axis=0), y - y.mean(), rcond=None)[0]
    df = spark.createDataFrame([(s, float(v), 1) for s, v in zip(sets, y, strict=True)] + [(["f1"], None, 1), (None, 0.5, 1)], "features array<string>, score double, at int")
    got = {r.feature: r.effect for r in attribution.regression(df).collect()}
    assert [got[n] for n in names] == pytest.approx(list(want), abs=1e-7)
    assert attribution.regression(df.limit(0)).count() == 0


def test_least_squares_of_many_features(spark):
    n = 50_000  # each row has two neighbours on a ring and a feature of many rows
    df = spark.range(2 * n).select(F.array(F.concat(F.lit("f"), (F.col("id") % n).cast("string")), F.concat(F.lit("f"), ((F.col("id") * 7 + 1) % n).cast("string"))).alias("features"), (F.col("id") % n % 5 + (F.col("id") * 7 + 1) % n % 5).cast("double").alias("score"))
    got = least_squares.membership(df, "features", "score", rounds=40)
    assert got.count() == n
    x = {r.feature: r.effect for r in got.collect()}
    left = [abs(x["f1"] - x["f0"] - 1), abs(x["f4"] - x["f2"] - 2), abs(x["f49999"] - x["f49995"] - 4)]
    assert max(left) < 1e-3

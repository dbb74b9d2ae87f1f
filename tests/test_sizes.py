"""What grows with the input stays off the driver, off single tasks and in proportion."""

import math

import compare
import pytest
from pyspark.sql import functions as F

from loomspark import registry
from loomspark.functions import numeric
from loomspark.operators import ranking, set_search, text
from loomspark.plans import pipeline, reports, store, trees


def _plans(monkeypatch, *modules):
    """Plans of all tables that these modules store, as they are stored."""
    seen = []
    for m in modules:
        keep = m.materialize
        monkeypatch.setattr(m, "materialize", lambda df, *a, keep=keep: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, *a))[1])
    return seen


@pytest.mark.parametrize("name", ["session_depths", "tree_balance", "tree_drawing", "tree_intervals", "tree_paths", "tree_stats"])
def test_tables_of_nodes_are_never_broadcast(spark, monkeypatch, name):
    n = F.col("id")
    h = spark.range(400).select(n.alias("node_id"), F.when(n > 0, F.floor((n - 1) / 2)).alias("parent_id"), F.lit("s").alias("session_id"), F.lit("o").alias("operation"), F.lit(0.5).alias("score"), F.lit(2).alias("visits"), F.lit("[1]").alias("features_after"))
    s = store.Store(None, h.repartition(4), None, None)
    seen = _plans(monkeypatch, store, trees)
    makes = {
        "session_depths": lambda: reports.deepest(s), "tree_balance": lambda: store.tree_balance(s), "tree_stats": lambda: store.tree_stats(s),
        "tree_drawing": lambda: trees.drawing(s.history, 400), "tree_intervals": lambda: trees.intervals(s.history, {"visits": ("sum", F.col("visits"))}), "tree_paths": lambda: trees.paths(s.history, h.select(F.col("node_id").alias("target"))),
    }
    out = makes[name]()
    if name != "tree_drawing":  # its last join is of the lines that it draws
        seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(seen) > 4 and not [p for p in seen if "BroadcastHashJoin" in p]
    assert out.count() == {"session_depths": 1, "tree_balance": 1, "tree_stats": 9, "tree_drawing": 400, "tree_intervals": 400, "tree_paths": sum(len(bin(i + 1)) - 2 for i in range(400))}[name]


@pytest.mark.parametrize("values", [[0, 1], [0, 0, 1, 2, 3, 3], list(range(50)), [5, 5, 5, 5, 7, 9]])
def test_quantiles_between_values_of_very_many_rows_are_found_in_few_rounds(spark, monkeypatch, values):
    rounds, keep = [], numeric._brackets
    monkeypatch.setattr(numeric, "_brackets", lambda p: (rounds.append(p), keep(p))[1] if len(rounds) < 12 else pytest.fail("no end"))
    monkeypatch.setattr(numeric, "SMALL", 20)
    n = 12_000 * len(values)
    df = spark.range(n).select(F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("id") % len(values) + 1).cast("int")).alias("x"))
    all_ = sorted(float(v) for v in values for _ in range(12_000))
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = [all_[int(q * (n - 1))] + (all_[min(int(q * (n - 1)) + 1, n - 1)] - all_[int(q * (n - 1))]) * (q * (n - 1) - int(q * (n - 1))) for q in at]
    assert numeric.quantiles(df, "x", at) == pytest.approx(want)


def test_overview_of_sessions_none_of_which_is_completed_agrees_with_its_sql(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    for name in ("orders", "lineitem", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{base}/{name}.parquet")
    spark.read.parquet(f"{base}/customer.parquet").withColumn("c_nationkey", F.lit(0)).toPandas().to_parquet(tmp_path / "customer.parquet")
    con_tables = [t for t in compare.TABLES if (tmp_path / f"{t}.parquet").exists()]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(compare, "TABLES", con_tables)
        assert compare.difference(spark, str(tmp_path), registry.QUERIES["store_dataset_overview"], registry.SQL["store_dataset_overview"]) is None


def test_ranks_of_more_values_than_may_be_broadcast_are_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_BROADCAST_VALUES", 50)
    df = spark.range(600).select((F.col("id") % 3).alias("g"), (F.col("id") % 100).alias("x"), "id")
    for out in (ranking.ranking_features(df, ["x"], "min"), ranking.group_percent_rank(df, "g", "x")):
        joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert not joins and out.count() == 600
    assert {(r.x, r.x_rank) for r in ranking.ranking_features(df, ["x"], "min").collect()} == {(i, 6.0 * i + 1) for i in range(100)}


def test_sets_of_one_frequent_feature_are_compared_by_classes(spark):
    n = F.col("id")
    sets = spark.range(6000).select(n.alias("set"), F.concat(F.array(F.lit("all")), F.transform(F.sequence(F.lit(1), n % 5 + 1), lambda i: F.concat(n.cast("string"), F.lit("-"), i.cast("string")))).alias("fs"))
    ranked = set_search._rarest_first(sets)
    assert set_search.similar_pairs(ranked, ranked, 4, 10).count() == 0  # 1200 * 1199 if sets of two features met by the frequent one
    found = set_search._by_frequent(ranked, ranked, 1000)
    assert found.count() <= 2 * 6000 and [r.b for r in found.where("a = 7").orderBy(F.col("shared") / F.col("total"), F.desc("b")).collect()] == [5, 0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no task gets all sets of a feature


def test_features_are_made_from_rows_that_are_computed_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(x):
        computed.add(1)
        return float(x)

    df = spark.range(200).repartition(4).select("id", (F.col("id") % 3).cast("string").alias("g"), F.udf(seen, "double")("id").alias("x"))
    out = pipeline.build(df, ["g"], ["x"], target="x").data
    assert out.count() == 200 and "x_mean_by_g" in out.columns and computed.value == 200


def test_entropy_takes_characters_out_of_what_is_left(spark):
    texts = ["", "a", "aab", "äöä𝒳x𝒳", "abc" * 50 + "é" * 7, "\n\n \t", "".join(chr(300 + i) for i in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.char_entropy(F.col("t")).alias("e"))
    for r in df.collect():
        shares = [r.t.count(c) / len(r.t) for c in set(r.t)]
        assert r.e == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9)
    assert "left" in df._jdf.queryExecution().analyzed().toString()  # what is left of a text is handed on

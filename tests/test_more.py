"""Stores, searches, dates, caches and other parts that have no SQL beside them."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomspark.operators import attribution, dates, quality, ranking, sampling
from loomspark.plans import evaluate, fitted, operations, pipeline, search, store
from loomspark.sources import feature_cache, safety, tables


def a_store(spark):
    sessions = spark.createDataFrame([("aaaa-1111-x", "one", "completed", "d", 5, 0.9, False, "2024-01-02", 60.0), ("aaaa-2222-x", "two", "active", "d", 0, None, False, "2024-01-03", 0.0), ("bbbb-3333-x", "two", "completed", "e", 2, 0.4, True, "2024-01-01", 10.0)], "session_id string, session_name string, status string, dataset_name string, total_iterations long, best_score double, is_test_mode boolean, start_time string, seconds double").withColumn("start_time", F.col("start_time").cast("timestamp"))
    rows = [(i, i - 1 if i else None, "aaaa-1111-x", i, "op", 0.1, 1, 1.0, None, 1.0, 1.0, "[]") for i in range(300)]
    rows += [(1000, 1001, "s", 0, "op", 0.1, 1, 1.0, None, 1.0, 1.0, "[]"), (1001, 1000, "s", 0, "op", 0.1, 1, 1.0, None, 1.0, 1.0, "[]"), (2000, 9999, "s", 0, "op", 0.1, 1, 1.0, None, 1.0, 1.0, "[]"), (2001, 2000, "s", 0, "op", 0.1, 1, 1.0, None, 1.0, 1.0, "[]")]
    history = spark.createDataFrame(rows, "node_id long, parent_id long, session_id string, iteration long, operation string, score double, visits long, ucb double, ts timestamp, seconds double, memory_mb double, features_after string")
    impact = spark.createDataFrame([("aaaa-1111-x", 1, 0.5, 1.0)], "session_id string, feature_no long, delta double, weight double")
    catalog = spark.createDataFrame([(1, "f_100%_a", "c", 1), (2, "f_100x_b", "c", 1)], "feature_no long, feature_name string, category string, cost int")
    return store.Store(sessions, history, impact, catalog)


def test_sessions_are_resolved_or_refused(spark):
    s = a_store(spark)
    assert store.resolve_session(s, "latest") == "aaaa-2222-x" and store.resolve_session(s, "aaaa-11") == "aaaa-1111-x" and store.resolve_session(s, "one") == "aaaa-1111-x"
    for text in ("aaaa", "two", "none", "cccc-33"):
        with pytest.raises(LookupError):
            store.resolve_session(s, text)
    assert store.health_exists(s, "aaaa-1111-x") and not store.health_exists(s, "x")
    assert {r.session_id: r.reason for r in store.cleanup_candidates(s).collect()} == {"aaaa-2222-x": "no progress", "bbbb-3333-x": "test"}
    assert [r.feature_no for r in store.search_features(s, "100%").collect()] == [1] and store.search_features(s, "f_100?_?").count() == 2
    with pytest.raises(ValueError):
        store.feature_rankings(s, metric="x; drop")


def test_deep_trees_cycles_and_orphans(spark):
    s = a_store(spark)
    depths = {r.node_id: r.depth for r in store.node_depths(s.history).collect()}
    assert depths == {i: i for i in range(300)}  # no depth on a cycle or below a missing node
    assert store.path_to(s, 3) == [0, 1, 2, 3] and store.path_to(s, 1000) == [1001, 1000]


def test_search_resumes_prunes_and_stops():
    ops = [search.Operation(x) for x in "abc"]
    make = lambda: search.Search(ops, lambda path: {"a": 0.9, "b": 0.2}.get(path[0], 0.5) if path else 0.1)
    s = make()
    s.run(12)
    again = make()
    again.resume(s.rows())
    assert again.rows() == s.rows() and again.best == s.best and again.nodes == s.nodes
    headless = make()
    headless.resume([r for r in s.rows() if r["node"]])
    assert headless.root.visits == sum(k.visits for k in s.root.children)
    gone = s.prune(0.05, 1)
    assert gone and all(n.operation for n in s.all_nodes() if n.number in gone) and s.select().number not in gone
    assert s.stats()["coverage"] == 1 and s.best_path()[0] == "a"
    n = len(s.history)
    s.run(5, seconds=0)
    s.run(5, memory_mb=0)
    assert len(s.history) == n


def test_dates(spark):
    rows = ["2024-02-29 10:11:12", "2024-02-29", "02/29/2024", "25/12/2023", "2024-03", "03/2024", "Mar 2024", "2024", "1709164800", "2999-01-01", "1850-01-01", "2024-13-45", "soon", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, d string")
    out = [r.asDict() for r in dates.date_columns(df, "d", "2025-01-01").orderBy("i").collect()]
    assert [r["d_precision"] for r in out[:9]] == ["second", "day", "day", "day", "month", "month", "month", "year", "epoch"]
    assert [r["d_text"] for r in out[1:8]] == ["2024-02-29", "2024-02-29", "2023-12-25", "2024-03", "2024-03", "2024-03", "2024"]
    assert [r["d_problem"] for r in out] == [None] * 9 + ["future", "too early", "unparsable", "unparsable", "missing", "missing"]
    assert out[4]["d_parsed"] == dt.datetime(2024, 3, 1)
    first = dates.date_columns(spark.createDataFrame([("03/04/2024",)], "d string"), "d", "2025-01-01", "us", day_first=True).first()
    assert first.d_text == "04/03/2024"


def test_stores_of_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", '{"x": {"y": 2}}'), (2, "B-c", None)], "k int, v string, j string")
    assert tables.insert(df, spark.createDataFrame([(3, 1)], "k int, other int")).count() == 3
    assert {r.k: r.v for r in tables.update_where(df, {"k": 2}, {"v": "z"}).collect()} == {1: "a", 2: "z"}
    assert tables.filtered(df, {"j": {"$json": {"$.x.y": 2}}}).count() == 1 and tables.filtered(df, {"v": {"$id": "bC"}}).count() == 1
    for kind in ("csv", "parquet", "json"):
        tables.export(df, str(tmp_path / f"t.{kind}"), kind)
        assert tables.read(spark, str(tmp_path / f"t.{kind}")).count() == 2
    with pytest.raises(ValueError):
        tables.export(df, str(tmp_path / "x"), "xls")
    assert tables.file_profile(spark, str(tmp_path / "t.parquet"))["rows"] == 2
    assert tables.read_split(spark, {"train": str(tmp_path / "t.csv")}, "train").columns == ["k", "v", "j"]
    done = tables.migrate(df, str(tmp_path / "m"), exclude=["j"], types={"k": "BIGINT"}, dry_run=True)
    assert done["types"] == {"k": "bigint", "v": "string"} and not (tmp_path / "m").exists()
    assert {r.column_name: (r.mean, r.unique_count, r.mode_frequency) for r in tables.column_metadata(df, ["k", "v"]).collect()} == {"k": (1.5, 2, 1), "v": (None, 2, 1)}
    cache, calls = feature_cache.FeatureCache(spark, f"file://{tmp_path}/cache"), []
    build = lambda: calls.append(1) or df
    assert cache.get_or_build("d", ["a", "b"], build).count() == cache.get_or_build("d", ["b", "a"], build).count() == 2 and len(calls) == 1
    assert cache.get("d", ["a"]) is None and cache.get("d", ["a", "b"], check_rows=True).columns == df.columns


def test_names_and_paths_from_outside():
    assert safety.identifier("a_1") == "a_1" and safety.allowed_path("file:///data/x/../y", ["file:///data"]) and safety.quoted("a`b") == "`a``b`"
    for bad in (lambda: safety.identifier("a;b"), lambda: safety.allowed_path("/data/../etc", ["/data"]), lambda: safety.allowed_path("/database", ["/data"]), lambda: safety.allowed_table("t", {"u"})):
        with pytest.raises(ValueError):
            bad()


def test_samples_and_strata(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "big").when(F.col("id") < 4999, "small"))
    for n in (0, 1, 10, 1234, 5000, 9000):
        got = sampling.exactly(df, n, ["id"])
        assert {r.id for r in got.collect()} == {r.id for r in df.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(n).collect()}
    train, test = sampling.stratified_holdout(df, "g", 0.2, ["id"])
    assert {r.g: r["count"] for r in test.groupBy("g").count().collect()} == {"big": 800, "small": 200} and train.count() == 4000 and not train.intersect(test).count()
    same = df.withColumn("k", F.lit(7))
    assert sampling.exactly(same, 100, ["k"]).count() == 100


def test_first_ranks_and_group_medians(spark):
    df = spark.createDataFrame([(i, x, "g" if i % 3 else "h") for i, x in enumerate([5.0, 1.0, 1.0, 7.0, None, 7.0, 2.0])], "i int, x double, g string")
    got = {r.i: r.x_rank for r in ranking.ranking_features(df, ["x"], "first", ["i"]).collect()}
    assert got == {1: 1, 2: 2, 6: 3, 0: 4, 3: 5, 5: 6, 4: 7}
    with pytest.raises(ValueError):
        ranking.ranking_features(df, ["x"], "first")
    assert {r.group: r.quantile for r in ranking.group_quantile(df, "g", "x").collect()} == {"g": 1.0, "h": 5.0}


def test_types_are_detected(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", f"some words {i} that differ", "ab"[i % 2], float(i), i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id int, day string, note string, kind string, x double, level int")
    assert quality.detect_types(df) == {"row_id": "id", "day": "datetime", "note": "text", "kind": "categorical", "x": "numeric", "level": "categorical"}


def test_encodings_are_learned_from_training_only(spark):
    train = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 0.0), ("b", 10.0, 1.0)], "c string, x double, y double")
    test = spark.createDataFrame([("a", 2.0), ("new", 50.0), (None, None)], "c string, x double")
    out = {r.c: r for r in fitted.transform(test, fitted.fit(train, ["c"], ["x"], "y", n_bins=2)).collect()}
    assert out["a"].x_mean_by_c == 2 and out["a"].c_frequency == pytest.approx(2 / 3) and out["a"].c_target_encoded == pytest.approx((1 + 2 / 3) / 3)
    assert out["new"].c_frequency == 0 and out["new"].c_target_encoded == pytest.approx(2 / 3) and out["new"].x_mean_by_c is None and out["new"].x_qbin == 1


def test_operations_by_name_and_lineage(spark):
    assert operations.check() == [] and operations.by_category("ranking") == ["ranking"] and "statistical" not in operations.applicable(False, True)
    assert operations.operation_of("x_mean_by_g") == "statistical" and operations.metadata("text").category == "text"
    with pytest.raises(KeyError):
        operations.metadata("none")
    df = spark.createDataFrame([("a", 1.0, 30.0, 50.0), ("b", 2.0, 10.0, 80.0), ("a", 4.0, 20.0, 60.0)], "g string, x double, temperature double, humidity double")
    t = pipeline.build(df, ["g"], ["x"], on_custom=1)
    assert "environmental_stress_score_squared" in t.data.columns and t.lineage["environmental_stress_score"] == "custom"
    assert t.made_of["x_mean_by_g"] == ["g", "x"] and t.dependencies("environmental_stress_score_squared") == ["environmental_stress_score"]
    assert pipeline.register(t, "test") == [] and {"feature_name": "x_squared", "origin": "generic", "operation_name": "polynomial", "dependencies": ["x"]} in pipeline.register(t, "train")


def test_subsets_are_scored_by_cross_validation(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 7), "yes" if i % 2 else "no") for i in range(60)], "good double, noise double, y string")
    assert evaluate.cross_validated(df, ["good"], "y", folds=2) == 1.0
    runs = evaluate.subset_benchmark(df, ["good", "noise"], "y", 6, score=lambda names: 1.0 if "good" in names else 0.5)
    effects = {r.feature: r.effect for r in attribution.marginal(runs).collect()}
    assert effects["good"] == 0.5 and runs.count() == 6 and not math.isnan(effects["noise"])


def test_rows_are_numbered_over_many_tasks(spark, monkeypatch):
    from loomspark.operators import groups

    df = spark.range(3000).select(F.pmod(F.col("id") * 7919, F.lit(3001)).alias("v"))
    few = {r.v: r.k for r in groups.numbered(df, [F.desc("v")], "k", 3000).collect()}
    monkeypatch.setattr(groups, "MAX_BROADCAST_GROUPS", 10)
    assert {r.v: r.k for r in groups.numbered(df.repartition(13), [F.desc("v")], "k", 3000).collect()} == few and sorted(few.values()) == list(range(3000))

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import attribution, binning, categorical, domain, polynomial, quality, ranking, sampling, statistical, temporal, text
from loomspark.plans import pipeline, search
from loomspark.sources import tables
from loomspark.streaming import windows

NUMBERS = [(1, "a", 3.0), (2, "a", None), (3, "b", float("nan")), (4, "b", float("inf")), (5, None, -2.0), (6, "c", 3.0), (7, "c", 0.0), (8, "c", 1e16), (9, "c", 7.5), (10, "a", 7.5)]


@pytest.fixture()
def numbers(spark):
    return spark.createDataFrame(NUMBERS, "id int, g string, x double")


def test_group_statistics_keep_rows_and_bounds(numbers):
    out = statistical.statistical_features(numbers, ["g"], ["x"]).toPandas()
    assert len(out) == len(NUMBERS)
    assert out[out.g.isna()].x_mean_by_g.isna().all()
    assert out.x_norm_by_g.dropna().between(0, 1).all()
    assert (out[out.g == "c"].x_count_by_g == 4).all()


def test_bins_equal_pandas(spark, numbers):
    v = pd.Series([1, 1, 2, 3, 3, 3, 4, 8, 9, 15, None, 20], dtype=float)
    df = spark.createDataFrame([(i, None if math.isnan(x) else x) for i, x in enumerate(v)], "i int, x double")
    got = binning.binning_features(df, ["x"], 4).orderBy("i").toPandas()
    assert got.x_qbin_4.tolist() == pd.qcut(v, 4, labels=False, duplicates="drop").fillna(-1).astype(int).tolist()
    assert (got[[c for c in got.columns if "_is_bin_" in c]].sum(axis=1) == (got.x_qbin_4 >= 0)).all()
    got = binning.binning_features(df, ["x"], 4, "uniform").orderBy("i").toPandas()
    assert got.x_ubin_4.tolist() == pd.cut(v, 4, labels=False).fillna(-1).astype(int).tolist()


@pytest.mark.parametrize("method", ["average", "min", "max", "dense"])
def test_ranks_equal_pandas(spark, method):
    v = pd.Series([5, 1, 1, 7, 7, 7, 2, 0, -3, 100], dtype=float)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "i int, x double")
    got = ranking.ranking_features(df, ["x"], method).orderBy("i").toPandas()
    assert got.x_rank.tolist() == v.rank(method=method).tolist()
    assert got.x_percentile.tolist() == (v.rank() / len(v)).tolist()
    r = v.rank(method=method)
    assert got.x_norm_rank.tolist() == pytest.approx(((r - 1) / (r.max() - 1)).tolist())


def test_ranks_of_missing_and_constant_columns(numbers):
    out = ranking.ranking_features(numbers.withColumn("k", F.lit(1.0)), ["x", "k"]).toPandas()
    assert (out.k_rank == 1).all() and (out.k_percentile == 0.5).all() and "k_decile" not in out
    assert out[out.id.isin([2, 3, 4])].x_rank.tolist() == [9.0] * 3  # after the seven numbers, as one tie


def test_polynomials_stay_within_bounds(numbers):
    out = polynomial.polynomial_features(numbers, ["x"], 3).toPandas()
    assert out.drop(columns=["x", "g"]).abs().max().max() <= 1e15
    assert out[out.id == 7].x_reciprocal.item() == 0


def test_text_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "Hello World! é"), (5, "ABC"), (6, "123"), (7, "a@b.com see http://x.y #tag @me 12:30")], "id int, s string")
    out = text.text_features(df, "s").toPandas().set_index("id")
    assert out.s_length.tolist()[:3] == [0, 0, 2] and out.s_word_count.tolist()[:4] == [0, 0, 0, 3]
    assert out.s_is_all_caps[5] == 1 and out.s_is_numeric[6] == 1 and out.s_char_entropy[5] == pytest.approx(math.log2(3))
    assert out.s_has_email[7] == out.s_has_url[7] == out.s_has_time[7] == 1 and out.s_hashtag_count[7] == 1


def test_categories(spark):
    df = spark.createDataFrame([(1, "a b", 1.0), (2, "a b", 3.0), (3, "c-d", 5.0), (4, None, None)], "id int, c string, y double")
    out = categorical.categorical_features(df, ["c"], "y", bits=True).toPandas().set_index("id")
    assert out.c_frequency.tolist() == pytest.approx([2 / 3, 2 / 3, 1 / 3, 0]) and out.c_label_encoded.tolist() == [0, 0, 1, -1]
    assert out.c_target_encoded[1] == pytest.approx((4 + 3) / 3) and out.c_target_encoded[4] == 3.0
    assert out.c_is_a_b.tolist() == [1, 1, 0, 0] and out.c_is_c_d.tolist() == [0, 0, 1, 0]
    assert [out.c_binary_bit_0[4], out.c_binary_bit_1[4]] == [1, 1]
    assert categorical.combination_features(df, "c", "id").toPandas().c_id_combination.tolist()[-1] == "nan_4"


def test_series_and_dates(spark):
    df = spark.createDataFrame([("u", i, float(i)) for i in range(5)], "u string, t int, x double")
    out = temporal.series_features(df, "x", ["t"], ["u"], expanding=True).orderBy("t").toPandas()
    assert out.x_lag_2.tolist()[2:] == [0, 1, 2] and out.x_rolling_mean_3.tolist() == [0, 0.5, 1, 2, 3] and out.x_cumsum.tolist() == [0, 1, 3, 6, 10]
    assert temporal.series_features(df, "x", ["t"], []).orderBy("t").toPandas().x_lag_2.tolist()[2:] == [0, 1, 2]
    dates = spark.createDataFrame([("2024-02-29",), ("29.02.2024",), ("02/29/2024",), ("1709164800",), ("1709164800000",), ("nonsense",), (None,)], "s string")
    got = [str(r[0])[:10] for r in dates.select(temporal.parse_mixed(F.col("s"))).collect()]
    assert got == ["2024-02-29"] * 5 + ["None"] * 2


def test_imputation(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 2, 1.0), ("u", 3, None), ("u", 4, 3.0), ("u", 5, None)], "u string, t int, x double")
    values = lambda d: [r.x for r in d.orderBy("t").collect()]
    assert values(quality.impute(df, "x")) == [2, 1, 2, 3, 2]
    assert values(quality.impute(df, "x", "fill", ["t"], ["u"])) == [1, 1, 1, 3, 3]
    assert values(quality.impute(df, "x", "interpolate", ["t"], ["u"])) == [1, 1, 2, 3, 3]
    assert quality.signal_columns(df.withColumn("k", F.lit(1)), ["x", "k"]) == ["x"]
    assert quality.clean_rows(spark.createDataFrame([(" A  b ", None), ("a b", "none")], "s string, n string")).collect()[0].s == "a b"


def test_samples_repeat_and_split(spark):
    df = spark.range(1000)
    assert sampling.exactly(df, 10, ["id"]).collect() == sampling.exactly(df, 10, ["id"]).collect()
    a, b = sampling.holdout(df, 0.2, ["id"])
    assert a.count() + b.count() == 1000 and not a.intersect(b).count() and 120 < b.count() < 280
    assert sampling.train_size(df, 0.1, ["id"]).count() == 100 and sampling.train_size(df, 5000, ["id"]).count() == 1000
    assert sampling.enlarge(df.withColumn("x", F.col("id").cast("double")), 3, ["x"], ["id"]).count() == 3000


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 2)], "k int, v string, ts int")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"], "ts").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert tables.filtered(old, {"k": {"$gte": 2}, "v": ["b", "c"]}).count() == 1 and tables.delete_where(old, {"k": 1}).count() == 1
    assert tables.from_json_rows(tables.as_json_rows(old, ["k"]), old.schema).exceptAll(old).count() == 0
    assert tables.split_files(["x_train.csv", "x_test.csv"]) == {"train": "x_train.csv", "test": "x_test.csv"}
    assert tables.detect_id(old) is None and tables.spark_type("VARCHAR(20)").simpleString() == "string"
    assert tables.schema_difference(old, old.drop("v"))["missing_in_second"] == ["v"]


def test_closest_sets(spark):
    runs = spark.createDataFrame([(1, ["a", "b"], 0.5), (2, ["a", "b", "c"], 0.7), (3, ["c"], 0.1)], "run int, features array<string>, score double")
    out = {r.run: (r.other, round(r.jaccard, 3)) for r in attribution.closest_set(runs).collect()}
    assert out == {1: (2, 0.667), 2: (1, 0.667), 3: (2, 0.333)}


def test_search_values_and_growth():
    assert search.ucb1(10, 3, 2.1, 1.4) == pytest.approx(0.7 + 1.4 * math.sqrt(math.log(10) / 3))
    assert search.ucb1(10, 0, 0.0) == math.inf
    ops = [search.Operation("a", gives=frozenset("x")), search.Operation("b", needs=frozenset("x")), search.Operation("c")]
    s = search.Search(ops, lambda path: 0.1 * len(path) + ("b" in path))
    score, path = s.run(20)
    assert {"a", "b"} <= set(path) and score == s.best[0]
    assert s.root.visits == len(s.history) and all(h["parent"] is not None or h["node"] == 0 for h in s.history)


def test_pipeline_and_alignment(numbers):
    t = pipeline.build(numbers.withColumn("same", F.lit(1.0)), ["g"], ["x"])
    assert set(t.lineage.values()) == {"original", "generic"} and t.data.count() == len(NUMBERS) and "same" in t.lineage
    train, test = pipeline.align(t.data, t.data.drop("x_squared", "g"), "g")
    assert "x_squared" not in train.columns and train.columns[-1] == "g" and "g" not in test.columns
    assert pipeline.operation_of("x_mean_by_g") == "statistical"


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", ["event_type"], "value", late="365 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").count() == windows.windowed(events, "ts", ["event_type"], "value").count()
    assert windows.sessions(events, "ts", "user_id").agg(F.sum("n")).first()[0] == events.count()


def test_char_codes_and_tf_idf(spark):
    df = spark.createDataFrame([(1, "aab"), (2, None), (3, "é")], "id int, s string")
    out = {r.id: (r.s_char_mean, r.s_char_std) for r in text.char_codes(df, "s").collect()}
    assert out[1] == pytest.approx((292 / 3, math.sqrt(2) / 3)) and out[2] == (0, 0) and out[3] == (233, 0)
    docs = ["red fox runs", "red fox", "blue fox", None]
    got = {(r.id, r.term): r.weight for r in text.tf_idf(spark.createDataFrame(list(enumerate(docs)), "id int, s string"), "id", "s").collect()}
    red, fox, both = math.log(5 / 3) + 1, math.log(5 / 4) + 1, math.log(5 / 3) + 1
    norm = math.sqrt(red**2 + fox**2 + both**2)
    assert got == pytest.approx({(i, t): w / norm for i in (0, 1) for t, w in (("red", red), ("fox", fox), ("red fox", both))} | {(2, "fox"): 1.0})


def test_regression_attribution(spark):
    runs = spark.createDataFrame([(["a"], 1.0), (["b"], 2.0), (["a", "b"], 2.5), ([], 0.5)], "features array<string>, score double")
    assert {r.feature: round(r.effect, 6) for r in attribution.regression(runs).collect()} == {"a": 0.5, "b": 1.5}


def test_passengers_and_crops(spark):
    df = spark.createDataFrame([("m", 1, "S", 8.0), ("f", 3, None, None), ("f", 3, "S", 30.0), ("m", 2, "C", None)], "sex string, pclass int, embarked string, age double")
    out = domain.domain_features(df).collect()
    assert [r.embarked_filled for r in out] == ["S", "S", "S", "C"] and out[3].sex_class_interaction == "m_class2" and out[3].embarked_c == 1
    assert [r.age_filled for r in out] == [8, 30, 30, None] and [r.age_group for r in out] == ["child", "young_adult", "young_adult", None]
    assert [r.sex_age_interaction for r in out] == ["m_child", "f_adult", "f_adult", "m_adult"]
    crop = spark.createDataFrame([("rice", 50.0, 40.0, 10.0, 40.0, 90.0, 5.0, 20.0)], "crop_name string, N double, P double, K double, temperature double, humidity double, ph double, rainfall double")
    r = domain.domain_features(crop).first()
    assert r.growing_condition_score == pytest.approx((0.25 + 1 - 35 / 45 + 1 - 2 / 3 + 0.1) / 4) and (r.stress_factor_count, r.crop_environment_match, r.recommendation_complexity) == (1, 0, "simple")
    both = crop.select(*[c.alias(n) for n, c in domain.agricultural_recommendation_features(crop, combined=True).items()]).first()
    assert (both.stress_factor_count, both.recommendation_complexity) == (5, "complex")  # hot, humid, acid, dry, little potassium
    assert domain.applicable(crop.drop("N")) == ["environmental_stress_features", "soil_crop_interaction_features", "agricultural_recommendation_features"]
    wide = domain.domain_features(crop.select("temperature")).columns
    assert "temp_stress_hot" in wide and "ph_stress_acidic" not in wide

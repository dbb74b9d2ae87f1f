from pyspark.sql import functions as F

from loomspark.operators import ranking


def test_many_values_are_ranked_in_ranges(spark, monkeypatch):
    df = spark.range(5000).select(F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 1009).cast("double")).alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"))
    few = [sorted(map(tuple, ranking.value_ranks(df, "x", g).select(*([F.coalesce("group", F.lit(-1))] if g else []), "value", "n", "before", "dense").collect())) for g in (None, "g")]
    monkeypatch.setattr(ranking, "MAX_BROADCAST_VALUES", 0)
    many = [sorted(map(tuple, ranking.value_ranks(df, "x", g).select(*([F.coalesce("group", F.lit(-1))] if g else []), "value", "n", "before", "dense").collect())) for g in (None, "g")]
    assert few == many
    values = sorted(r.x for r in df.where("x is not null").collect())
    seen = sorted(set(values))
    first = {v: values.index(v) for v in seen}
    assert few[0] == [(v, values.count(v), first[v], i + 1) for i, v in enumerate(seen)]
    for rows in (ranking.group_percent_rank(df, "g", "x"), ranking.group_percent_rank(df.where("false"), "g", "x")):
        assert rows.columns == ["x", "g", "x_pct_rank_by_g"]
        for r in rows.where("g = 1 and x = 5").collect():
            own = [v.x for v in df.where("g = 1 and x is not null").collect()]
            assert abs(r.x_pct_rank_by_g - (sum(v < 5 for v in own) + (sum(v == 5 for v in own) + 1) / 2) / len(own)) < 1e-12

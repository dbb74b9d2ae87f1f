"""What features are worth, from scores of sets of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import set_search


def marginal(runs: DataFrame, features: str = "features", score: str = "score") -> DataFrame:
    """(feature, with_mean, without_mean, effect): mean score of the sets with a feature, less that of the others."""
    total = runs.agg(F.count(score).alias("tn"), F.sum(score).alias("ts"))
    per = runs.select(F.explode(F.array_distinct(features)).alias("feature"), F.col(score).alias("s")).groupBy("feature").agg(F.count("s").alias("n"), F.sum("s").alias("s"))
    t = total.first()
    rest = F.lit(t["tn"]) - F.col("n")
    out = per.select("feature", (F.col("s") / F.col("n")).alias("with_mean"), F.when(rest > 0, (F.lit(t["ts"]) - F.col("s")) / rest).alias("without_mean"))
    return out.withColumn("effect", F.col("with_mean") - F.coalesce("without_mean", F.lit(0.0)))


def closest_set(runs: DataFrame, id_col: str = "run", features: str = "features", score: str = "score", frequent: int = set_search.FREQUENT) -> DataFrame:
    """(run, other, jaccard, other_score): for each set the other one that is most like it and shares a feature; ties go to the least id.

    Ids are unique. Runs with equal sets are each other's partners; only different sets are searched, without a limit (set_search.py).
    """
    one = runs.select(F.col(id_col).alias("run"), F.array_sort(F.array_distinct(F.array_compact(features))).alias("fs"), F.col(score).alias("score")).where(F.size("fs") > 0)
    one = materialize(one, "runs")
    same = one.groupBy("fs").agg(F.min("run").alias("set"), F.count("*").alias("members"))
    named = materialize(one.join(same, "fs"), "named-runs")
    second = named.where("run <> set").groupBy("set").agg(F.min("run").alias("second"))
    best = set_search.most_similar(same.select("set", "fs"), frequent)
    twins = named.where("members > 1").join(second, "set").select("run", F.when(F.col("run") == F.col("set"), F.col("second")).otherwise(F.col("set")).alias("other"), F.lit(1.0).alias("jaccard"))
    single = named.where("members = 1").join(best, F.col("set") == F.col("a")).select("run", F.col("b").alias("other"), "jaccard")
    scores = one.select(F.col("run").alias("other"), F.col("score").alias("other_score"))
    return twins.unionByName(single).join(scores, "other").select("run", "other", "jaccard", "other_score")


def regression(runs: DataFrame, features: str = "features", score: str = "score", rounds: int | None = None) -> DataFrame:
    """(feature, effect): least-squares weights of membership in the sets, with an intercept, the smallest ones where several fit as well."""
    from . import least_squares

    return least_squares.membership(runs, features, score, rounds)

"""Scores of feature sets by models that Spark trains."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_validated(df: DataFrame, features: list[str], target: str, folds: int = 3, model=None, metric: str = "accuracy", seed: int = 42) -> float:
    """The mean of a metric over folds; rows without a target are left out, missing numbers count as 0."""
    data = df.where(F.col(target).isNotNull()).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(target).cast("string").alias("_target"))
    labelled = StringIndexer(inputCol="_target", outputCol="label").fit(data).transform(data)
    steps = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model or RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed)])
    check = CrossValidator(estimator=steps, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(metricName=metric), numFolds=folds, seed=seed)
    return check.fit(labelled).avgMetrics[0]


def subset_benchmark(df: DataFrame, features: list[str], target: str, runs: int, least: int = 1, most: int | None = None, folds: int = 3, seed: int = 42, score=None) -> DataFrame:
    """(run, features, score) of random subsets of features, the same in every run: what attribution works on."""
    pick, rows, seen = random.Random(seed), [], {}
    score = score or (lambda names: cross_validated(df, names, target, folds, seed=seed))
    for i in range(runs):
        names = sorted(pick.sample(features, pick.randint(least, most or len(features))))
        if tuple(names) not in seen:
            seen[tuple(names)] = float(score(names))
        rows.append((i, names, seen[tuple(names)]))
    return df.sparkSession.createDataFrame(rows, "run int, features array<string>, score double")

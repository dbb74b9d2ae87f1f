"""Sparse least squares by conjugate gradients: each step multiplies the table of sets by a vector in tasks, and adds up a number a feature.

The driver holds vectors with a number for each feature, the rows never. Columns are centred in the products, so that an intercept is fitted
but not penalised, and steps start at zero, so that of several solutions the smallest is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import materialize
from .groups import numbered


def _indexed(runs: DataFrame, features: str, score: str) -> tuple[DataFrame, DataFrame]:
    """(at, y): each row's features as numbers, and its score; (at, feature, n): the features, numbered by name."""
    rows = materialize(runs.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(F.array_compact(features)).alias("fs"), F.col(score).cast("double").alias("y")).where("fs is not null and y is not null"), "regression-rows")
    names = materialize(rows.select(F.explode("fs").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")), "regression-features")
    names = materialize(numbered(names, [F.asc("feature")], "at", names.count()).withColumn("at", F.col("at").cast("int")), "regression-numbers")
    sets = rows.select("row", F.explode("fs").alias("feature")).join(names, "feature").groupBy("row").agg(F.collect_list("at").alias("at"))
    return materialize(rows.select("row", "y").join(sets, "row", "left").select(F.coalesce("at", F.array().cast("array<int>")).alias("at"), "y"), "regression-table"), names


def _summed(table: DataFrame, values, width: int) -> np.ndarray:
    """Sums over rows of values(rows' sets, scores) at each row's features; the last place has the sum over all rows. values gets (flat, row of each, rows, y)."""
    def run(batches):
        out = np.zeros(width + 1)
        for b in batches:
            at = b.column(0)
            start, flat = np.asarray(at.offsets), np.asarray(at.values)
            flat = flat[start[0] : start[-1]]
            row = np.repeat(np.arange(b.num_rows), np.diff(start))
            v = values(flat, row, b.num_rows, b.column(1).to_numpy())
            out[:-1] += np.bincount(flat, weights=v[row], minlength=width)
            out[-1] += v.sum()
        some = np.flatnonzero(out)
        for i in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 50_000]), pa.array(out[some[i : i + 50_000]])], names=["at", "v"])

    got = table.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # a row a feature
    out = np.zeros(width + 1)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def membership(runs: DataFrame, features: str, score: str, rounds: int | None = None, tolerance: float = 1e-12) -> DataFrame:
    """(feature, effect): the weights of being in a row's set that fit its score best."""
    spark = runs.sparkSession
    ship(spark)
    table, names = _indexed(runs, features, score)
    found = names.select("at", "feature", "n").orderBy("at").toPandas()  # a row a feature
    width, total = len(found), table.agg(F.count("*").alias("n"), F.avg("y").alias("m")).first()
    share = found["n"].to_numpy(float) / max(total["n"], 1)
    mean = total["m"]
    grad = _summed(table, lambda flat, row, n, y: y - mean, width)[:-1] if width else np.zeros(0)
    x, step, size = np.zeros(width), grad.copy(), float(grad @ grad)
    goal = size * tolerance**2
    for _ in range(rounds or 2 * width + 10):
        if size <= goal:
            break
        sent = spark.sparkContext.broadcast(step)
        shift = float(share @ step)
        got = _summed(table, lambda flat, row, n, y, sent=sent, shift=shift: np.bincount(row, weights=sent.value[flat], minlength=n) - shift, width)
        sent.destroy()
        product = got[:-1] - share * got[-1]
        by = size / float(step @ product)
        x, grad = x + by * step, grad - by * product
        last, size = size, float(grad @ grad)
        step = grad + size / last * step
    return spark.createDataFrame(pd.DataFrame({"feature": found["feature"], "effect": x}), "feature string, effect double")

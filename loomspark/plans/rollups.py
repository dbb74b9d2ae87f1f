"""Running statistics by period, kept as sketches: periods are merged, not read again.

A row a period and key holds counts, sums, least and greatest values, a KLL sketch of the values and a HyperLogLog sketch of another column's
distinct values. With k = 200 a quantile's rank is off by some 1.3 % at most (99 of 100 times); distinct counts by some 1.6 % at lgK = 12.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, LG_K = 200, 12


def rollup(df: DataFrame, time: str, keys: list[str], value: str, distinct: str | None = None, unit: str = "day", k: int = K, lg_k: int = LG_K) -> DataFrame:
    """(period, keys, n, total, least, most, sketch[, distinct_sketch]) of each period; nulls and NaN don't count."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    new = [F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, k).alias("sketch")]
    if distinct:
        new.append(F.hll_sketch_agg(F.col(distinct).cast("string"), lg_k).alias("distinct_sketch"))
    return df.groupBy(F.date_trunc(unit, F.col(time).cast("timestamp")).alias("period"), *keys).agg(*new)


def store(rollups: DataFrame, path: str, keys: list[str]) -> None:
    """Add periods to a folder; periods that are there already are replaced, whole."""
    spark = rollups.sparkSession
    writer = rollups.withColumn("of", F.date_format("period", "yyyyMMddHH")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("of").parquet(path)


def merged(rollups: DataFrame, keys: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """The same columns but for the period, over all periods from start up to, not including, end."""
    for bound, test in ((start, F.col("period") >= F.lit(start).cast("timestamp")), (end, F.col("period") < F.lit(end).cast("timestamp"))):
        rollups = rollups.where(test) if bound is not None else rollups
    new = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch")]
    if "distinct_sketch" in rollups.columns:
        new.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    return rollups.groupBy(*keys).agg(*new)


def estimates(table: DataFrame, quantiles=(0.5, 0.9, 0.95)) -> DataFrame:
    """Counts, means, and the quantiles and distinct values that the sketches give, as columns p50, p90, ... and n_distinct; null where nothing was counted."""
    new = {"mean": F.try_divide("total", "n")} | {f"p{round(q * 100)}": F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))) for q in quantiles}
    if "distinct_sketch" in table.columns:
        new["n_distinct"] = F.hll_sketch_estimate("distinct_sketch")
    return table.withColumns(new).drop("sketch", "distinct_sketch")

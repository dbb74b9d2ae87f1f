"""Joining groups' aggregates to their rows: pre-aggregated, so a hot group is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

MAX_BROADCAST_GROUPS = 100_000


def numbered(df: DataFrame, order: list[Column], name: str, n: int) -> DataFrame:
    """df with its rows numbered from 0 in this order; n rows, which are sorted in one task if few and by ranges if many."""
    if n <= MAX_BROADCAST_GROUPS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    # a sort by ranges puts earlier rows in earlier partitions; the id has the partition above 33 bits, and the row below
    own = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_k"))  # a row a partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(sizes), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_before")


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column], null_groups: bool = False) -> DataFrame:
    """df with an aggregate of each row's group under each name; rows with a null key get null unless null_groups."""
    marks = [f"_key{i}" for i in range(len(keys))]
    rows = df if null_groups else df.where(" and ".join(f"`{k}` is not null" for k in keys))
    agg = rows.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, marks, strict=True)]).agg(*[c.alias(n) for n, c in stats.items()])
    on = None
    for k, m in zip(keys, marks, strict=True):
        one = df[k].eqNullSafe(agg[m]) if null_groups else df[k] == agg[m]
        on = one if on is None else on & one
    small = agg.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    return df.join(F.broadcast(agg) if small else agg, on, "left").drop(*marks)

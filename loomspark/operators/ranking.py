"""Ranks over a whole table, or within groups, without putting either in one task.

A column's distinct values are counted; the counts are summed at once if they are few, else in two levels, over ranges of values and over
rows within a range; the sums are joined back. Heavy ties collapse in the counting, ranges are bounded by quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, profile
from ..storage import large, materialize
from . import series
from .binning import cut, shares
from .groups import MAX_BROADCAST_GROUPS

RANGES = 256
MAX_BROADCAST_VALUES = 200_000


def _range_of(value: Column, edges: list[float]) -> Column:
    """How many edges are below a value."""
    return F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<double>"), lambda e: e < value))


def value_ranks(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """([group,] value, n, before, dense) of each distinct finite value: rows with it, rows below it, its dense rank, over all rows or in its group."""
    x, keys = finite(F.col(col)), ["group"] if group else []
    own = [F.col(group).alias("group")] if group else []
    counts = materialize(df.select(*own, x.alias("value")).where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n")), "value-counts")
    if counts.count() <= MAX_BROADCAST_VALUES:  # so few that a group's values, or all, may be one task
        whole = Window.partitionBy(*keys).orderBy("value")
        return counts.select(*keys, "value", "n", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.row_number().over(whole).alias("dense"))
    edges = sorted(set(df.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []))
    ranged = counts.withColumn("r", _range_of(F.col("value"), edges))
    sums = ranged.groupBy(*keys, "r").agg(F.sum("n").alias("n"), F.count("*").alias("d"))  # RANGES rows a group at most
    below = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("r").alias("_r"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("r_before"), F.coalesce(F.sum("d").over(below), F.lit(0)).alias("r_dense"))
    inner = Window.partitionBy(*keys, "r").orderBy("value")
    before = F.coalesce(F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.col("r") == F.col("_r")
    if group:
        on = on & F.col("group").eqNullSafe(F.col("_group"))
    joined = ranged.withColumn("i_before", before).withColumn("i_dense", F.row_number().over(inner)).join(sums if group else F.broadcast(sums), on)
    return joined.select(*keys, "value", "n", (F.col("r_before") + F.col("i_before")).alias("before"), (F.col("r_dense") + F.col("i_dense")).alias("dense"))


def _quantiles(ranks: DataFrame, n: int, at: list[float]) -> dict[float, float]:
    """The quantiles of n values, linear between neighbours, from their ranks; a row for each neighbour."""
    places = {q: q * (n - 1) for q in at}
    sought = sorted({f(p) for p in places.values() for f in (math.floor, math.ceil)})
    holds = F.exists(F.lit(sought), lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n")))
    rows = ranks.where(holds).select("value", "n", "before").collect()
    value = {r: next(x["value"] for x in rows if x["before"] <= r < x["before"] + x["n"]) for r in sought}
    return {q: value[math.floor(p)] + (value[math.ceil(p)] - value[math.floor(p)]) * (p - math.floor(p)) for q, p in places.items()}


def ranking_features(df: DataFrame, cols: list[str], method: str = "average", order: list[str] = (), most: int = series.MOST) -> DataFrame:
    """{x}_rank, _dense_rank, _percentile, _norm_rank, _quartile, _decile, _is_top10pct, _is_bottom10pct, _above_median, _zscore_rank.

    Missing values come last, as one tie, in ranks. A constant column has rank 1 and percentile 0.5 only. method: average,
    min, max, dense or first; first tells equal values apart by `order`, columns that say which row is first.
    """
    if method == "first" and not order:
        raise ValueError("name the columns that put rows of equal values in order")
    four, ten = shares(4), shares(10)
    stats, out, total = profile(df, cols, ()), df, df.count()
    for x in cols:
        p, v = stats[x], finite(F.col(x))
        if p["distinct"] <= 1:
            out = out.withColumns({f"{x}_rank": F.lit(1.0), f"{x}_percentile": F.lit(0.5)})
            continue
        ranks = materialize(value_ranks(df, x), "value-ranks")
        last = ranks.agg(F.max(F.struct("value", "before", "n", "dense")).alias("r"), F.count("*").alias("k")).first()
        distinct, last = last["k"], last["r"]
        q = _quantiles(ranks, p["n"], [*four, *ten, 0.5])
        few = F.broadcast(ranks) if distinct <= MAX_BROADCAST_VALUES else large(ranks)
        missing = total - p["n"]
        joined = out.join(few.select(F.col("value").alias("_value"), F.col("n").alias("_n"), F.col("before").alias("_before"), F.col("dense").alias("_dense")), v == F.col("_value"), "left")
        n, before = F.coalesce("_n", F.lit(missing)), F.coalesce("_before", F.lit(p["n"]))
        dense = F.coalesce("_dense", F.lit(distinct + 1)).cast("double")
        average = before + (n + 1) / 2
        if method == "first":  # rows of one value, however many, are numbered in order
            joined = series.running(joined, ["_value"], list(order), {"_nth": F.lit(1).cast("long")}, most=most)
        nth = F.col("_nth") if method == "first" else F.lit(1)
        rank = {"average": average, "min": before + 1, "max": before + n, "dense": dense, "first": before + nth}[method].cast("double")
        if missing:
            most = {"average": p["n"] + (missing + 1) / 2, "min": p["n"] + 1, "max": total, "dense": distinct + 1, "first": total}[method]
        else:
            most = {"average": last["before"] + (last["n"] + 1) / 2, "min": last["before"] + 1, "max": total, "dense": distinct, "first": total}[method]
        pct = F.least(F.greatest(average / total, F.lit(0.0)), F.lit(1.0))
        z = (v - p["mean"]) / p["std"] if p["std"] else None
        new = {
            f"{x}_rank": rank, f"{x}_dense_rank": dense, f"{x}_percentile": pct, f"{x}_norm_rank": (rank - 1) / float(most - 1) if most > 1 else F.lit(0.5),
            f"{x}_is_top10pct": (pct >= 0.9).cast("int"), f"{x}_is_bottom10pct": (pct <= 0.1).cast("int"), f"{x}_above_median": F.coalesce(v > q[0.5], F.lit(False)).cast("int"),
            f"{x}_zscore_rank": F.coalesce(1 / (1 + F.exp(-z / 2)), F.lit(0.5)) if z is not None else F.lit(0.5), f"{x}_quartile": cut(v, sorted({q[s] for s in four})),
        }
        if distinct >= 10:
            new[f"{x}_decile"] = cut(v, sorted({q[s] for s in ten}))
        out = joined.withColumns(new).drop("_value", "_n", "_before", "_dense", "_nth")
    return out


def group_percent_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """{x}_pct_rank_by_{g}: the average rank of finite values within the group, over the group's rows that have one."""
    ranks = value_ranks(df, value, group)
    sizes = ranks.groupBy(F.col("group").alias("_g2")).agg(F.sum("n").alias("_all"))
    names = ranks.join(sizes, F.col("group").eqNullSafe(F.col("_g2"))).select(F.col("group").alias("_g"), F.col("value").alias("_v"), ((F.col("before") + (F.col("n") + 1) / 2) / F.col("_all")).alias(f"{value}_pct_rank_by_{group}"))
    names = materialize(names, "group-ranks")
    few = F.broadcast(names) if names.count() <= MAX_BROADCAST_VALUES else large(names)
    return df.join(few, df[group].eqNullSafe(F.col("_g")) & (finite(df[value]) == F.col("_v")), "left").drop("_g", "_v")


def group_quantile(df: DataFrame, group: str, value: str, q: float = 0.5) -> DataFrame:
    """(group, quantile): the exact quantile of each group's finite values, linear between neighbours; a hot group's values are dealt over tasks."""
    ranks = value_ranks(df, value, group)
    sizes = ranks.groupBy(F.col("group").alias("_g")).agg(((F.sum("n") - 1) * F.lit(float(q))).alias("_at"))
    on = ranks.join(F.broadcast(sizes) if sizes.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else sizes, F.col("group").eqNullSafe(F.col("_g")))
    has = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col("value")))
    low, high = F.floor("_at"), F.ceil("_at")
    picked = on.groupBy("group").agg(has(low).alias("lo"), has(high).alias("hi"), F.max(F.col("_at") - F.floor("_at")).alias("part"))
    return picked.select("group", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("quantile"))

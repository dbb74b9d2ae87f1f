"""Encodings learned from one table and applied to others, so that nothing of a test table enters its features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_numeric, finite, profile, safe_divide
from ..operators.binning import cut, shares
from ..operators.groups import MAX_BROADCAST_GROUPS
from ..storage import materialize


@dataclass
class Fitted:
    """What training has seen: scalars and edges of numbers, and a small table for each category column."""

    numbers: dict[str, dict] = field(default_factory=dict)
    edges: dict[str, list[float]] = field(default_factory=dict)
    groups: dict[str, DataFrame] = field(default_factory=dict)
    few: dict[str, bool] = field(default_factory=dict)
    target_mean: float | None = None


def fit(train: DataFrame, categories: list[str] = (), values: list[str] = (), target: str | None = None, n_bins: int = 5, smoothing: float = 1.0) -> Fitted:
    values, out = list(values), Fitted()
    out.numbers = profile(train, values, tuple(sorted({*shares(n_bins), 0.5}))) if values else {}
    out.edges = {x: sorted({p["q"][s] for s in shares(n_bins)}) for x, p in out.numbers.items() if p["n"]}
    n, y = train.count(), finite(F.col(target)) if target else None
    if target:
        out.target_mean = train.agg(F.avg(y)).first()[0]
    for c in categories:
        aggs = [F.count("*").alias("_n"), (F.count("*") / F.lit(max(n, 1))).alias(f"{c}_frequency")]
        for x in values:
            v = clean_numeric(F.col(x), out.numbers[x]["q"][0.5])
            aggs += [F.avg(v).alias(f"{x}_mean_by_{c}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{x}_std_by_{c}"), F.min(v).alias(f"{x}_min_by_{c}"), F.max(v).alias(f"{x}_max_by_{c}")]
        if target:
            aggs.append(((F.sum(y) + smoothing * out.target_mean) / (F.count(y) + smoothing)).alias(f"{c}_target_encoded"))
        out.groups[c] = materialize(train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(*aggs), "fitted")
        out.few[c] = out.groups[c].limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    return out


def transform(df: DataFrame, fitted: Fitted) -> DataFrame:
    """The table with the columns that training defines; categories that it has not seen have frequency 0, its target mean, and null statistics."""
    out = df
    for c, table in fitted.groups.items():
        out = out.join(F.broadcast(table) if fitted.few[c] else table, F.col(c) == F.col("_v"), "left").drop("_v", "_n")
        new: dict[str, Column] = {f"{c}_frequency": F.coalesce(f"{c}_frequency", F.lit(0.0))}
        if fitted.target_mean is not None:
            new[f"{c}_target_encoded"] = F.coalesce(f"{c}_target_encoded", F.lit(fitted.target_mean))
        for x, p in fitted.numbers.items():
            v, lo, hi = clean_numeric(F.col(x), p["q"][0.5]), F.col(f"{x}_min_by_{c}"), F.col(f"{x}_max_by_{c}")
            new |= {f"{x}_dev_from_{c}_mean": F.coalesce(v - F.col(f"{x}_mean_by_{c}"), F.lit(0.0)), f"{x}_norm_by_{c}": F.least(F.greatest(safe_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(1.0))}
        out = out.withColumns(new)
    bins = {f"{x}_qbin": cut(F.least(F.greatest(finite(F.col(x)), F.lit(e[0])), F.lit(e[-1])), e) for x, e in fitted.edges.items() if len(e) > 1}
    return out.withColumns(bins) if bins else out

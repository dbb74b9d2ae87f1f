"""Quantile and equal-width bins with right-closed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, profile, quantiles


def cut(x: Column, edges: list[float]) -> Column:
    """The number of the right-closed interval that x is in, the lowest edge included; -1 for null or outside."""
    out = F.when(x.isNull() | (x < edges[0]) | (x > edges[-1]), -1)
    for i, e in enumerate(edges[1:]):
        out = out.when(x <= e, i)
    return out.otherwise(-1).cast("int")


def shares(n: int) -> list[float]:
    """0, 1/n, ..., 1."""
    return [i / n for i in range(n + 1)]


def binning_features(df: DataFrame, cols: list[str], n_bins: int = 5, strategy: str = "quantile", dummies: bool = True) -> DataFrame:
    """{x}_qbin_{n} (or _ubin_, _bin_) and an indicator {x}_is_bin_{k} of each bin, for up to 10 bins."""
    stats, new = profile(df, cols, tuple(shares(n_bins)) if strategy != "uniform" else ()), {}
    for x in cols:
        n, lo, hi = min(n_bins, stats[x]["distinct"]), stats[x]["min"], stats[x]["max"]
        if n < 2:
            continue
        v = finite(F.col(x))
        if strategy == "uniform":
            width = (hi - lo) / n
            name, b, count = f"{x}_ubin_{n_bins}", F.when(v.isNull(), -1).otherwise(F.least(F.greatest(F.ceil((v - lo) / width) - 1, F.lit(0)), F.lit(n - 1))).cast("int"), n
        else:
            q = stats[x]["q"] if n == n_bins else dict(zip(shares(n), quantiles(df, x, shares(n)), strict=True))
            edges = sorted({q[s] for s in shares(n)})
            name, b, count = f"{x}_{'qbin' if strategy == 'quantile' else 'bin'}_{n_bins}", cut(v, edges), len(edges) - 1
        new[name] = b
        if dummies and n <= 10:
            new |= {f"{x}_is_bin_{k}": (b == k).cast("int") for k in range(count)}
    return df.withColumns(new)

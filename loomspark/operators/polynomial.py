"""Powers, logarithms, roots, reciprocals and products of numeric columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import TINY, clean_numeric, clip, profile


def polynomial_features(df: DataFrame, cols: list[str], degree: int = 2, interactions: bool = True) -> DataFrame:
    """{x}_squared, _cubed (degree 3), _log, _sqrt, _reciprocal, and {a}_x_{b} of the first three columns.

    Columns with large values are scaled before they are raised, so that results stay within 1e15.
    """
    stats = profile(df, cols)
    new, top = {}, {}
    for x in cols:
        p = stats[x]
        v = clean_numeric(F.col(x), p["q"][0.5])
        lo, hi = min(p["min"] or 0.0, p["q"][0.5] or 0.0), max(p["max"] or 0.0, p["q"][0.5] or 0.0)
        top[x] = max(abs(lo), abs(hi))
        if degree >= 2:
            new[f"{x}_squared"] = clip(F.pow(v / 1000 if top[x] > 1000 else v, F.lit(2.0)))
        if degree >= 3:
            new[f"{x}_cubed"] = clip(F.pow(v / 10000 if top[x] > 100 else v, F.lit(3.0)))
        if hi > 0:
            new[f"{x}_log"] = F.when(v > 0, F.log1p(v)).otherwise(0.0)
        if hi >= 0:
            new[f"{x}_sqrt"] = F.when(v >= 0, F.sqrt(v)).otherwise(0.0)
        new[f"{x}_reciprocal"] = clip(F.when(F.abs(v) > TINY, 1 / F.when(F.abs(v) > TINY, v)).otherwise(0.0))
    if interactions:
        for a, b in combinations(cols[:3], 2):
            va, vb = (clean_numeric(F.col(c), stats[c]["q"][0.5]) for c in (a, b))
            m = max(top[a], top[b])
            scale = (m / 1000) ** 0.5 if m > 1000 else 1.0
            new[f"{a}_x_{b}"] = clip((va / scale) * (vb / scale))
    return df.withColumns(new)


def arithmetic_features(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sum, difference, product, quotient and share of two columns."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.withColumns({f"{a}_plus_{b}": x + y, f"{a}_minus_{b}": x - y, f"{a}_times_{b}": x * y, f"{a}_div_{b}": x / F.when(y == 0, None).otherwise(y), f"{a}_ratio_sum_{b}": x / F.when(x + y == 0, None).otherwise(x + y)})

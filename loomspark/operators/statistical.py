"""Group statistics, joined to every row: mean, std, deviation, count, min, max, place in the group's range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_numeric, profile, safe_divide
from .groups import with_group_stats


def statistical_features(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """For each group column g and value x: {x}_mean_by_{g}, _std_, _count_, _min_, _max_, {x}_dev_from_{g}_mean, {x}_norm_by_{g}.

    Missing values count as the median; rows with a null group have null statistics, and 0 deviation.
    """
    fills = {x: p["q"][0.5] for x, p in profile(df, values).items()}
    out = df
    for g in groups:
        clean = {x: clean_numeric(F.col(x), fills[x]) for x in values}
        stats = {}
        for x, c in clean.items():
            stats |= {f"{x}_mean_by_{g}": F.avg(c), f"{x}_std_by_{g}": F.coalesce(F.stddev_samp(c), F.lit(0.0)), f"{x}_count_by_{g}": F.count(c), f"{x}_min_by_{g}": F.min(c), f"{x}_max_by_{g}": F.max(c)}
        out = with_group_stats(out, [g], stats)
        more = {}
        for x, c in clean.items():
            lo, hi = F.col(f"{x}_min_by_{g}"), F.col(f"{x}_max_by_{g}")
            more[f"{x}_dev_from_{g}_mean"] = F.coalesce(c - F.col(f"{x}_mean_by_{g}"), F.lit(0.0))
            more[f"{x}_norm_by_{g}"] = F.least(F.greatest(safe_divide(c - lo, hi - lo), F.lit(0.0)), F.lit(1.0))
        out = out.withColumns(more)
    return out


def group_zscore(df: DataFrame, group: str, value: str) -> DataFrame:
    """{x}_zscore_by_{g}: distance from the group's mean in its standard deviations (plus 1e-5)."""
    x = F.col(value).cast("double")
    out = with_group_stats(df, [group], {"_mean": F.avg(x), "_std": F.stddev_samp(x)})
    return out.withColumn(f"{value}_zscore_by_{group}", (x - F.col("_mean")) / (F.coalesce("_std", F.lit(0.0)) + 1e-5)).drop("_mean", "_std")

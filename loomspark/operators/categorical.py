"""Encodings of categories: frequency, count, rank, target mean and variance, indicators, labels, bits, combinations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..storage import materialize
from .groups import MAX_BROADCAST_GROUPS, numbered


def categorical_features(df: DataFrame, cols: list[str], target: str | None = None, max_onehot: int = 10, smoothing: float = 1.0, bits: bool = False) -> DataFrame:
    """{c}_frequency, _count, _frequency_rank, _label_encoded; with a target _target_encoded and _target_variance; {c}_is_{value} for few values; on demand {c}_binary_bit_{i}.

    Null is no category: frequency and count 0, rank and label -1, the overall mean as its target encoding. Ties in
    frequency go by value.
    """
    out = df
    y = finite(F.col(target)) if target else None
    mean = df.agg(F.avg(y)).first()[0] if target else None
    for c in cols:
        aggs = [F.count("*").alias("_n")] + ([F.avg(y).alias("_mean"), F.count(y).alias("_yn"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("_var")] if target else [])
        per = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(*aggs)
        per = materialize(per, "categories")
        n_values, total = per.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        per = numbered(numbered(per, [F.desc("_n"), F.asc("_v")], "_rank", n_values), [F.asc("_v")], "_label", n_values).withColumn("_share", F.col("_n") / F.lit(max(total, 1)))
        out = out.join(F.broadcast(per) if n_values <= MAX_BROADCAST_GROUPS else per, F.col(c) == F.col("_v"), "left")
        label = F.coalesce("_label", F.lit(-1)).cast("int")
        new = {f"{c}_frequency": F.coalesce("_share", F.lit(0.0)), f"{c}_count": F.coalesce("_n", F.lit(0)), f"{c}_frequency_rank": F.coalesce("_rank", F.lit(-1)).cast("int"), f"{c}_label_encoded": label}
        if target:
            new[f"{c}_target_encoded"] = F.coalesce((F.col("_mean") * F.col("_yn") + mean * smoothing) / (F.col("_yn") + smoothing), F.lit(mean))
            new[f"{c}_target_variance"] = F.coalesce("_var", F.lit(0.0))
        if n_values <= max_onehot:
            for (v,) in sorted(per.select("_v").collect()):  # at most max_onehot rows
                new[f"{c}_is_{str(v).replace(' ', '_').replace('-', '_')}"] = F.coalesce(F.col(c) == v, F.lit(False)).cast("int")
        if bits:
            new |= {f"{c}_binary_bit_{i}": F.shiftright(label, i).bitwiseAND(F.lit(1)) for i in range(math.ceil(math.log2(n_values + 1)))}
        out = out.withColumns(new).drop("_v", "_n", "_mean", "_yn", "_var", "_rank", "_label", "_share")
    return out


def combination_features(df: DataFrame, a: str, b: str) -> DataFrame:
    """{a}_{b}_combination and its share of rows; null reads as 'nan'."""
    both = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in (a, b)])
    out = df.withColumn(f"{a}_{b}_combination", both)
    freq = out.groupBy(F.col(f"{a}_{b}_combination").alias("_v")).agg(F.count("*").alias("_n"))
    total = df.count()
    small = freq.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    return out.join(F.broadcast(freq) if small else freq, F.col(f"{a}_{b}_combination") == F.col("_v"), "left").withColumn(f"{a}_{b}_combination_frequency", F.col("_n") / max(total, 1)).drop("_v", "_n")


def rare_flags(df: DataFrame, col: str, share: float = 0.01) -> DataFrame:
    """{c}_is_rare: the value has less than this share of all rows."""
    out = categorical_features(df, [col], max_onehot=0)
    return out.withColumn(f"{col}_is_rare", (F.col(f"{col}_count") < share * df.count()).cast("int")).drop(f"{col}_frequency", f"{col}_count", f"{col}_frequency_rank", f"{col}_label_encoded")

"""Samples that reruns repeat: rows are chosen by the hash of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fast_hash(keys: list[str], seed: int) -> Column:
    """64 bits by XXH64: the usual choice."""
    return F.xxhash64(F.lit(seed), *keys)


def portable_hash(keys: list[str], seed: int) -> Column:
    """The first 60 bits of the MD5 of the seed and the keys as text, in the upper bits of a long; other engines find the same rows. Null reads as an empty text."""
    text = F.concat_ws("\x01", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.shiftleft(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") - F.lit(1 << 59), 4)


Hash = Callable[[list[str], int], Column]


def below(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among this share of all."""
    return F.lit(True) if share >= 1 else h < F.lit(int(max(0.0, share) * 2**64) - 2**63)


def exactly(df: DataFrame, n: int, keys: list[str], seed: int = 42, hashed: Hash = fast_hash) -> DataFrame:
    """n rows (all if there are fewer), by the least hashes, then by the keys; only the rows near the last hash are sorted."""
    total = df.count()
    if n <= 0 or n >= total:
        return df if n > 0 else df.limit(0)
    h, slack = hashed(keys, seed), 6 * n**0.5 + 20
    while True:
        lo, hi = (n - slack) / total, (n + slack) / total
        sure, near = df.where(below(h, lo)), df.where(~below(h, lo) & below(h, hi))
        have = df.agg(F.count_if(below(h, lo)).alias("lo"), F.count_if(below(h, hi)).alias("hi")).first()
        if have["lo"] <= n <= have["hi"]:
            return sure.unionByName(near.orderBy(h, *keys).limit(n - have["lo"]))
        slack *= 4  # repeated keys bunch their rows


def bernoulli(df: DataFrame, share: float, keys: list[str], seed: int = 42, hashed: Hash = fast_hash) -> DataFrame:
    """Each row with this probability; needs no shuffle, and copies of a key go together."""
    return df.where(below(hashed(keys, seed), share))


def train_size(df: DataFrame, size: float | int, keys: list[str], seed: int = 42, hashed: Hash = fast_hash) -> DataFrame:
    """A share of all rows if size is a float of at most 1, else that many rows."""
    n = df.count()
    want = int(n * size) if isinstance(size, float) and size <= 1 else int(size)
    return df if want >= n else exactly(df, want, keys, seed, hashed)


def per_stratum(df: DataFrame, stratum: str, k: int, order: list[str]) -> DataFrame:
    """The first k rows of each stratum in this order; Spark keeps k rows a task before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def proportional(df: DataFrame, stratum: str, target: int, order: list[str]) -> DataFrame:
    """max(1, target * rows of the stratum // all rows) rows of each stratum, in this order."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}  # one row a stratum
    total = sum(sizes.values())
    most = max((max(1, target * n // total) for n in sizes.values()), default=1)
    want = F.greatest(F.lit(1), F.floor(F.lit(target) * F.col("_n") / F.lit(max(total, 1))))
    counts = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= most)
    return ranked.join(counts, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("_r") <= want).drop("_r", "_s", "_n")


def holdout(df: DataFrame, share: float, keys: list[str], seed: int = 42, hashed: Hash = fast_hash) -> tuple[DataFrame, DataFrame]:
    """(train, test): no key is in both; in expectation every stratum is split alike."""
    test = below(hashed(keys, seed), share)
    return df.where(~test), df.where(test)


def stratified_holdout(df: DataFrame, stratum: str, share: float, keys: list[str], seed: int = 42, hashed: Hash = fast_hash) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each stratum's n rows the round(n * share) of least hash are test; keys are taken to be unique.

    A stratum's ranks are taken in two levels, over ranges of the hash and within them, so that a large one is no hot task.
    """
    h = hashed(keys, seed)
    parts = 1 << 10
    ranged = df.withColumn("_h", h).withColumn("_p", F.shiftright("_h", 54))  # 1,024 ranges of the hash
    sizes = ranged.groupBy(F.col(stratum).alias("_s"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s")
    sizes = sizes.withColumn("_all", F.sum("_n").over(w)).withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most `parts` rows a stratum
    own = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", *keys))
    ranked = ranged.withColumn("_r", own).join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    test = F.col("_before") + F.col("_r") <= F.round(F.col("_all") * F.lit(float(share)))
    assert parts == 1 << (64 - 54)
    return tuple(ranked.where(t).select(*df.columns) for t in (~test, test))


def enlarge(df: DataFrame, times: int, cols: list[str], keys: list[str], noise: float = 0.05, seed: int = 42) -> DataFrame:
    """Each row `times` times, numbers with normal noise of a share of their deviation, the same in every run."""
    std = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    def normal(c: str) -> Column:
        u, v = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(i), "copy", *keys), F.lit(1 << 30)) + 1) / float((1 << 30) + 1) for i in (0, 1))
        return F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)

    return out.withColumns({c: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.col(c) + normal(c) * (noise * (std[c] or 0.0))) for c in cols})

"""Ordered scans over series of any length: a long series is cut into pieces by ranges of its order, and what one piece
needs of those before it, or after, is carried over its border.

Only series of over `most` rows are cut, so that the others cost one window as usual. Cut rows are dealt by ranges and stored
once; a table with a row a piece holds counts, sums and last values, and windows over it give each piece what came before.
Rows that are equal in all columns of the order can't be told apart and stay in one piece: end the order in an id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import materialize
from .groups import MAX_BROADCAST_GROUPS

MOST = 1_000_000
PIECE, HALO = "_piece", "_halo"


def _hint(df: DataFrame) -> DataFrame:
    """A small table is broadcast; its rows are counted."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else df


def _on(keys: list[str], other: str = "_k"):
    """Equal keys, null among them, against columns that were renamed by _renamed()."""
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"{other}{i}"))
    return test


def _renamed(keys: list[str], other: str = "_k") -> list[Column]:
    return [F.col(k).alias(f"{other}{i}") for i, k in enumerate(keys)]


def split(df: DataFrame, keys: list[str], order: list[str], most: int = MOST) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary series, rows of long ones with the number of their piece); None where there are none.

    Pieces of a series follow each other in order and hold some `most` rows at the most.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)  # one task sums what all have counted
    total = sizes.agg(F.sum("_n")).first()[0]
    if not total:
        return df.withColumn(PIECE, F.lit(0)), None
    long = _hint(materialize(sizes.select(*_renamed(keys)), "long-series")) if keys else None
    hot = df.join(long, _on(keys), "left_semi") if keys else df
    dealt = hot.repartitionByRange(math.ceil(2 * total / most), *keys, *order).withColumn(PIECE, F.spark_partition_id())
    rest = df.join(long, _on(keys), "left_anti").withColumn(PIECE, F.lit(0)) if keys else None
    return rest, materialize(dealt, "pieces")


def _both(rest: DataFrame | None, hot: DataFrame | None) -> DataFrame:
    parts = [x for x in (rest, hot) if x is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def window(keys: list[str], order: list[str]) -> WindowSpec:
    """Rows of a piece in order."""
    return Window.partitionBy(*keys, PIECE).orderBy(*order)


def with_borders(pieces: DataFrame, keys: list[str], order: list[str], width: int) -> DataFrame:
    """pieces, and before each one the last `width` rows of its series that come before it, marked by HALO."""
    back = Window.partitionBy(*keys, PIECE).orderBy(*[F.desc_nulls_last(c) for c in order])
    tails = pieces.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= width)  # width rows a piece at most
    tails = materialize(tails.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(PIECE, F.desc("_back")))).drop("_back"), "borders")
    starts = tails.groupBy(*keys, PIECE).agg(F.min("_at").alias("_start"))
    need = starts.select(*_renamed(keys), F.col(PIECE).alias("_for"), F.explode(F.sequence(F.greatest(F.col("_start") - width, F.lit(1)), F.col("_start"))).alias("_need"), "_start").where("_need < _start")
    halo = tails.join(need, _on(keys) & (F.col("_at") == F.col("_need"))).withColumn(PIECE, F.col("_for")).select(*pieces.columns)
    return pieces.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def carried(pieces: DataFrame, keys: list[str], each: dict[str, Column], over: dict[str, Callable[[str, WindowSpec], Column]], backward: bool = False) -> DataFrame:
    """pieces with the columns of `over`: values of all earlier (or later) pieces of a row's series; null before the first.

    each: aggregates of a piece, by name. over: what is made of them, by name: a function of a window over the pieces before.
    """
    sums = materialize(pieces.groupBy(*keys, PIECE).agg(*[v.alias(n) for n, v in each.items()]), "piece-sums")
    w = Window.partitionBy(*keys).orderBy(F.desc(PIECE) if backward else F.asc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    table = sums.select(*_renamed(keys), F.col(PIECE).alias("_p"), *[f(w).alias(n) for n, f in over.items()])
    return pieces.join(_hint(table), _on(keys) & (F.col(PIECE) == F.col("_p"))).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None, most: int = MOST) -> DataFrame:
    """df with running sums and exclusive-ors up to each row of its series, by name; nulls count as nothing."""
    wanted = {n: (F.sum, v) for n, v in (sums or {}).items()} | {n: (F.bit_xor, v) for n, v in (xors or {}).items()}
    rest, hot = split(df.withColumns({f"_v_{n}": v for n, (_, v) in wanted.items()}), keys, order, most)
    upto = window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    new = {n: f(f"_v_{n}").over(upto) for n, (f, _) in wanted.items()}
    if hot is not None:
        hot = carried(hot, keys, {n: f(f"_v_{n}") for n, (f, _) in wanted.items()}, {f"_c_{n}": (lambda w, f=f, n=n: f(n).over(w)) for n, (f, _) in wanted.items()}).withColumns(new)
        join = {F.sum: lambda a, b: a + b, F.bit_xor: lambda a, b: a.bitwiseXOR(b)}
        hot = hot.withColumns({n: F.coalesce(join[f](F.col(n), F.col(f"_c_{n}")), n, f"_c_{n}") for n, (f, _) in wanted.items()}).drop(*[f"_c_{n}" for n in wanted])
    return _both(rest.withColumns(new) if rest is not None else None, hot).drop(PIECE, *[f"_v_{n}" for n in wanted])


def _windows(value: str, w: WindowSpec, lags, windows) -> dict[str, Column]:
    x = F.col(value)
    new = {f"{value}_lag_{k}": F.lag(value, k).over(w) for k in lags}
    for n in windows:
        last = w.rowsBetween(1 - n, 0)
        new |= {f"{value}_rolling_mean_{n}": F.avg(x).over(last), f"{value}_rolling_std_{n}": F.coalesce(F.stddev_samp(x).over(last), F.lit(0.0)), f"{value}_rolling_min_{n}": F.min(x).over(last), f"{value}_rolling_max_{n}": F.max(x).over(last)}
    return new


def series_statistics(df: DataFrame, value: str, order: list[str], keys: list[str], lags=(1, 2, 3), windows=(3, 7), expanding: bool = False, most: int = MOST) -> DataFrame:
    """{x}_lag_{k}, {x}_rolling_{mean,std,min,max}_{w}, and on demand expanding mean, std and sum, for series of any length."""
    rest, hot = split(df, keys, order, most)
    x, w = F.col(value), window(keys, order)
    new, upto = _windows(value, w, lags, windows), w.rowsBetween(Window.unboundedPreceding, 0)
    more = {f"{value}_expanding_mean": F.avg(x).over(upto), f"{value}_expanding_std": F.coalesce(F.stddev_samp(x).over(upto), F.lit(0.0)), f"{value}_cumsum": F.sum(x).over(upto)} if expanding else {}
    if rest is not None:
        rest = rest.withColumns(new | more)
    if hot is not None:
        columns = hot.columns
        if expanding:  # squares are summed around a series' mean, so that they lose no digits
            mid = hot.groupBy(*keys).agg(F.avg(value).alias("_mid"))
            hot = hot.join(_hint(mid.select(*_renamed(keys), "_mid")), _on(keys)).select(*columns, "_mid")
            off = x - F.col("_mid")
            each = {"n": F.count(value), "s": F.sum(value), "d": F.sum(off), "q": F.sum(off * off)}
            hot = carried(hot, keys, each, {f"_c_{k}": (lambda v, k=k: F.sum(k).over(v)) for k in each})
            own = F.when(~F.col(HALO), x)
            off = own - F.col("_mid")
            sofar = {k: F.coalesce(f.over(upto), F.lit(0)) + F.coalesce(F.col(f"_c_{k}"), F.lit(0)) for k, f in {"n": F.count(own), "s": F.sum(own), "d": F.sum(off), "q": F.sum(off * off)}.items()}
            n, spread = sofar["n"], F.greatest(sofar["q"] - F.try_divide(sofar["d"] * sofar["d"], sofar["n"]), F.lit(0.0))
            more = {f"{value}_expanding_mean": F.try_divide(sofar["s"], n), f"{value}_expanding_std": F.coalesce(F.sqrt(F.try_divide(spread, n - 1)), F.lit(0.0)), f"{value}_cumsum": F.when(n > 0, sofar["s"])}
        hot = with_borders(hot, keys, order, max([1, *lags, *(k - 1 for k in windows)]))
        hot = hot.withColumns(new | more).where(~F.col(HALO)).select(*columns, *new, *more)
    return _both(rest, hot).drop(PIECE)


def fill(df: DataFrame, col: str, order: list[str], keys: list[str], how: str = "fill", most: int = MOST) -> DataFrame:
    """Fill nulls of series of any length. fill: by the last value before, else the first after; interpolate: on the line between them, by row."""
    if how not in ("fill", "interpolate"):
        raise ValueError(f"unknown way to fill: {how}")
    rest, hot = split(df, keys, order, most)
    w = window(keys, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(col).alias("x")))
    near = {"_a": F.last(known, True).over(before), "_b": F.first(known, True).over(after)}

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_i", F.row_number().over(w).cast("long"))

    if rest is not None:
        rest = numbered(rest).withColumns(near)
    if hot is not None:
        hot = carried(numbered(hot), keys, {"n": F.count("*")}, {"_c": lambda v: F.sum("n").over(v)}).withColumn("_i", F.col("_i") + F.coalesce("_c", F.lit(0))).drop("_c")
        hot = materialize(hot, "numbered")
        hot = carried(hot, keys, {"m": F.max(known)}, {"_last": lambda v: F.last("m", True).over(v)})
        hot = carried(hot, keys, {"m": F.min(known)}, {"_next": lambda v: F.last("m", True).over(v)}, backward=True)
        hot = hot.withColumns({"_a": F.coalesce(near["_a"], "_last"), "_b": F.coalesce(near["_b"], "_next")}).drop("_last", "_next")
    out = _both(rest, hot)
    a, b = F.col("_a.x"), F.col("_b.x")
    if how == "fill":
        value = F.coalesce(a, b)
    else:
        gap = F.col("_b.i") - F.col("_a.i")
        value = F.coalesce(F.col(col).cast("double"), a + (b - a) * (F.col("_i") - F.col("_a.i")) / F.when(gap == 0, 1).otherwise(gap), a, b)
    return out.withColumn(col, value).drop("_i", "_a", "_b", PIECE)

"""Numeric kernels: what counts as a number, guarded division, profiles of columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1e15
TINY = 1e-10


def finite(c: Column) -> Column:
    """The column as double; NaN and infinities become null."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(c: Column, lo: float = -LIMIT, hi: float = LIMIT) -> Column:
    return F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo)))


def clean_numeric(c: Column, fill: float | None) -> Column:
    """Finite values within +-1e15; others become fill (profile()'s median, or 0)."""
    return clip(F.coalesce(finite(c), F.lit(float(fill or 0.0))))


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, with denominators of less than 1e-10 taken as 1e-10, and 0 where that is not finite."""
    q = n.cast("double") / F.when(F.abs(d) < TINY, F.lit(TINY)).otherwise(d.cast("double"))
    return F.coalesce(finite(q), F.lit(0.0))


#: A sketch's rank error is at most 1 / ACCURACY of its rows; brackets reach twice as far.
ACCURACY = 10_000
SMALL = 5_000
FEW_DISTINCT = 1_000


@dataclass
class _Sought:
    """A rank (from 0) whose value is sought: it is in [lo, hi], with `below` values less than lo and `inside` in the bracket, of which some are equal to its ends."""

    col: str
    rank: int
    lo: float
    hi: float
    least: float
    most: float
    below: int = 0
    inside: int = 0
    at_lo: int = 0
    at_hi: int = 0

    def missed(self) -> bool:
        """Whether the rank is outside after all; the bracket is then the side that it is on."""
        if self.below <= self.rank < self.below + self.inside:
            return False
        self.lo, self.hi = (self.least, self.lo) if self.rank < self.below else (self.hi, self.most)
        return True

    def between(self) -> int:
        """How many values are left strictly inside the bracket; none once the rank is known to fall on one of its ends, however many values equal it."""
        if self.lo < self.hi and self.rank < self.below + self.at_lo:
            self.hi = self.lo
        elif self.lo < self.hi and self.rank >= self.below + self.inside - self.at_hi:
            self.lo = self.hi
        return 0 if self.lo == self.hi else self.inside - self.at_lo - self.at_hi


def _brackets(positions: list[float]) -> list[float]:
    return [min(1.0, max(0.0, p + s)) for p in positions for s in (-2 / ACCURACY, 2 / ACCURACY)]


def order_statistics(df: DataFrame, sought: list[_Sought], also: list[Column] = ()) -> tuple[dict[tuple[str, int], float], Row | None]:
    """{(col, rank): value} of the finite values, exactly, and the aggregates `also`, which are taken in the same job.

    Brackets from sketches are counted, and narrowed by a sketch of what is strictly inside, until few values are left; these are
    counted and collected. A bracket's ends are counted apart, so that values of very many rows end the search or leave the next bracket. No task holds more than a sketch, whatever the table's size.
    """
    done, found, extra = [], {}, None
    while sought or also:
        counted = lambda x, t: F.struct(F.count_if(x < t.lo).alias("below"), F.count_if(x.between(t.lo, t.hi)).alias("inside"), F.count_if(x == t.lo).alias("at_lo"), F.count_if(x == t.hi).alias("at_hi"))
        aggs = [F.struct(*[counted(finite(F.col(t.col)), t).alias(f"s{i}") for i, t in enumerate(sought)]).alias("counts")] if sought else []
        row = df.agg(*aggs, *also).first()
        extra, also = extra or row, ()
        wide, again = [], []
        for i, t in enumerate(sought):
            t.below, t.inside, t.at_lo, t.at_hi = row["counts"][f"s{i}"]
            (again if t.missed() else done if t.between() <= SMALL else wide).append(t)
        if wide:
            row = df.agg(*[F.percentile_approx(F.when((finite(F.col(t.col)) > t.lo) & (finite(F.col(t.col)) < t.hi), finite(F.col(t.col))), _brackets([(t.rank - t.below - t.at_lo) / max(t.between() - 1, 1)]), ACCURACY).alias(f"s{i}") for i, t in enumerate(wide)]).first()
            for i, t in enumerate(wide):
                t.lo, t.hi = row[f"s{i}"]
        sought = wide + again
    for c in {t.col for t in done}:
        own = [t for t in done if t.col == c]
        open_ = [t for t in own if t.lo < t.hi]
        x = finite(F.col(c))
        counts = []
        if open_:  # at most SMALL values a rank
            within = reduce(lambda a, b: a | b, [x.between(lo, hi) for lo, hi in {(t.lo, t.hi) for t in open_}])
            counts = sorted((r[0], r[1]) for r in df.where(within).groupBy(x.alias("x")).count().collect())
        for t in own:
            at, found[c, t.rank] = t.below, t.lo
            for v, n in counts if t.lo < t.hi else ():
                if t.lo <= v <= t.hi:
                    at += n
                    if at > t.rank:
                        found[c, t.rank] = v
                        break
    return found, extra


def profile(df: DataFrame, cols: list[str], quantiles: tuple[float, ...] = (0.5,)) -> dict[str, dict]:
    """Of each column's finite values: n, min, max, mean, std, distinct (exact up to FEW_DISTINCT, estimated beyond), quantiles (exact, linear between neighbours)."""
    aggs = []
    for c in cols:
        x = finite(F.col(c))
        aggs.append(F.struct(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.approx_count_distinct(x).alias("distinct"), F.percentile_approx(x, _brackets(list(quantiles)), ACCURACY).alias("q") if quantiles else F.lit(None).alias("q")).alias(c))
    row = df.agg(*aggs).first() if cols else {}
    out, sought, few = {}, [], []
    for c in cols:
        p = out[c] = row[c].asDict()
        near, p["q"] = p["q"] or [], {}
        for i, q in enumerate(quantiles if p["n"] else ()):
            at = q * (p["n"] - 1)
            sought += [_Sought(c, r, near[2 * i], near[2 * i + 1], p["min"], p["max"]) for r in sorted({math.floor(at), math.ceil(at)})]
        if p["distinct"] <= FEW_DISTINCT:
            few.append(c)
    unique = {(t.col, t.rank): t for t in sought}
    found, extra = order_statistics(df, list(unique.values()), [F.count_distinct(finite(F.col(c))).alias(f"distinct {c}") for c in few])
    for c in cols:
        p = out[c]
        if c in few:
            p["distinct"] = extra[f"distinct {c}"]
        for q in quantiles:
            at = q * (p["n"] - 1)
            lo, hi = (found.get((c, f(at))) for f in (math.floor, math.ceil))
            p["q"][q] = None if lo is None else lo + (hi - lo) * (at - math.floor(at))
    return out


def quantiles(df: DataFrame, col: str, at: list[float]) -> list[float]:
    """The exact quantiles of a column's finite values; none if it has no values."""
    q = profile(df, [col], tuple(at))[col]["q"]
    return [q[x] for x in at if q[x] is not None]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: Parts of names that keep a column out of automatic choice.
FORBIDDEN = ("target", "label", "price", "id", "row_id", "sample_id")


def usable_columns(df: DataFrame, cols: list[str] | None = None, forbidden=FORBIDDEN) -> list[str]:
    """The columns named, or all numeric ones whose name has none of the forbidden parts."""
    return cols if cols is not None else [c for c in numeric_columns(df) if not any(p in c.lower() for p in forbidden)]

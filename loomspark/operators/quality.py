"""Missing values, outliers, validation, selection and clean-up."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, numeric_columns, profile
from . import series
from .groups import MAX_BROADCAST_GROUPS
from .ranking import group_quantile


def missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in cols})


def impute(df: DataFrame, col: str, how: str = "median", order: list[str] | None = None, partition: list[str] | None = None, most: int = series.MOST) -> DataFrame:
    """Fill nulls by median, mode (the least of the most frequent), fill (last before, else first after) or interpolate; series of over `most` rows in pieces."""
    x = F.col(col)
    if how == "median":
        return df.withColumn(col, F.coalesce(x, F.lit(profile(df, [col])[col]["q"][0.5])))
    if how == "mode":
        return df.withColumn(col, F.coalesce(x, F.lit(mode_of(df, col))))
    return series.fill(df, col, order, partition or [], how, most)


def group_impute(df: DataFrame, col: str, groups: list[str], how: str = "median", overall: bool = True) -> DataFrame:
    """Fill nulls by the median or mode of one group column after another, then by that of all rows; modes by count, then by value."""
    out = df
    for g in groups:
        if how == "median":
            stat = group_quantile(df, g, col).select(F.col("group").alias("_group"), F.col("quantile").alias("_stat"))
        else:
            counts = df.where(F.col(col).isNotNull()).groupBy(F.col(g).alias("_group"), F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
            stat = counts.groupBy("_group").agg(F.min(F.struct(-F.col("_n"), "_v"))["_v"].alias("_stat"))
        small = stat.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
        out = out.join(F.broadcast(stat) if small else stat, F.col(g) == F.col("_group"), "left").withColumn(col, F.coalesce(col, "_stat")).drop("_group", "_stat")
    if not overall:
        return out
    rest = profile(df, [col])[col]["q"][0.5] if how == "median" else mode_of(df, col)
    return out.withColumn(col, F.coalesce(col, F.lit(rest)))


def mode_of(df: DataFrame, col: str):
    """The least of the most frequent values."""
    row = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")).agg(F.min(F.struct(-F.col("_n"), col))[col].alias("v")).first()
    return row["v"]  # null if there are no values


def outlier_features(df: DataFrame, cols: list[str], iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """{x}_is_outlier_iqr, {x}_is_outlier_z, {x}_capped_iqr, {x}_capped_pct (1st and 99th percentile)."""
    stats, new = profile(df, cols, (0.01, 0.25, 0.75, 0.99)), {}
    for c in cols:
        p, x = stats[c], F.col(c)
        if not p["n"]:
            continue
        q = p["q"]
        reach = iqr * (q[0.75] - q[0.25])
        lo, hi = q[0.25] - reach, q[0.75] + reach
        new |= {f"{c}_is_outlier_iqr": ((x < lo) | (x > hi)).cast("int"), f"{c}_capped_iqr": F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))), f"{c}_capped_pct": F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(q[0.01])), F.lit(q[0.99])))}
        new[f"{c}_is_outlier_z"] = (F.abs(x - p["mean"]) > z * p["std"]).cast("int") if p["std"] else F.lit(0)
    return df.withColumns(new)


def validate(df: DataFrame, cols: list[str] | None = None, extreme: float = 1e10) -> DataFrame:
    """(column_name, n_null, n_nan, n_inf, n_zero, n_negative, n_extreme) of each numeric column, in one scan."""
    cols = cols or numeric_columns(df)
    tests = {"n_null": lambda x: x.isNull(), "n_nan": F.isnan, "n_inf": lambda x: F.abs(x) == float("inf"), "n_zero": lambda x: x == 0, "n_negative": lambda x: x < 0, "n_extreme": lambda x: F.abs(x) > extreme}
    one = df.agg(*[F.struct(*[F.count_if(t(F.col(c).cast("double"))).alias(k) for k, t in tests.items()]).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in cols])).alias("r")).select("r.column_name", "r.s.*")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns, in one scan."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def drop_correlated(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """The columns that stay: of a pair with |r| above the limit, the later one goes."""
    gone = {r.b for r in correlations(df, cols).where(F.abs("r") > limit).collect()}  # a row a pair of columns
    return [c for c in cols if c not in gone]


def drop_low_variance(df: DataFrame, cols: list[str], limit: float = 0.0) -> list[str]:
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > limit]


def signal_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with two distinct values at least: their least and greatest differ. One scan for all."""
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def detect_types(df: DataFrame) -> dict[str, str]:
    """id, datetime, text, categorical or numeric for each column, in one scan; distinct values are estimated.

    id: named so, and nearly all values differ; datetime: of such a type, or nearly all texts start like a date; text: most
    values differ or are over 50 characters in the mean; numbers of under 20 values are categorical.
    """
    dtypes, n = dict(df.dtypes), F.count("*")
    date = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^\d{1,2}[./-]\d{1,2}[./-]\d{4}"
    aggs = [F.struct(n.alias("n"), F.count(c).alias("k"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), 14)).alias("d"), F.avg(F.length(F.col(c).cast("string"))).alias("length"), F.avg(F.col(c).cast("string").rlike(date).cast("double")).alias("date")).alias(c) for c in df.columns]
    row, out = df.agg(*aggs).first(), {}
    for c in df.columns:
        s, t = row[c], dtypes[c]
        if "id" in c.lower() and s["n"] and s["d"] > 0.8 * s["n"]:
            out[c] = "id"
        elif t.startswith(("date", "timestamp")) or t == "string" and (s["date"] or 0) > 0.8:
            out[c] = "datetime"
        elif t == "string":
            out[c] = "text" if s["k"] and (s["d"] > 0.8 * s["k"] or (s["length"] or 0) > 50) else "categorical"
        else:
            out[c] = "categorical" if t == "boolean" or s["d"] < 20 else "numeric"
    return out


def clean_rows(df: DataFrame) -> DataFrame:
    """Trim, lower and collapse spaces of strings; 'nan', 'null', 'none' and '' become null; drop repeated rows and all-null columns."""
    strings = [n for n, t in df.dtypes if t == "string"]
    tidy = {c: F.trim(F.lower(F.regexp_replace(c, r"[ \t\n]+", " "))) for c in strings}
    out = df.withColumns({c: F.when(~v.isin("nan", "null", "none", ""), v) for c, v in tidy.items()}).dropDuplicates()
    counts = out.agg(*[F.count(c).alias(c) for c in out.columns]).first()
    return out.select(*[c for c in out.columns if counts[c]])


def shape_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """{x}_log where all values are positive and the bias-corrected skewness exceeds 1 in size; {x}_squared where over 10 values differ (sketches count that few exactly)."""
    aggs = [F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.skewness(c).alias("g"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), 14)).alias("d")).alias(c) for c in cols]
    row, new = df.agg(*aggs).first(), {}
    for c in cols:
        n, lo, g, d = row[c]
        if lo is not None and lo > 0 and n > 2 and abs(g * (n * (n - 1)) ** 0.5 / (n - 2)) > 1:
            new[f"{c}_log"] = F.log1p(c)
        if d > 10:
            new[f"{c}_squared"] = F.pow(F.col(c).cast("double"), F.lit(2.0))
    return df.withColumns(new)


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def column_fingerprints(df: DataFrame, cols: list[str], rows: list[str]) -> DataFrame:
    """(column_name, kind, fingerprint): a sum over rows of hashes of the row and the value, in one scan and whatever the rows' order.

    rows: columns that tell rows apart; equal fingerprints of one kind mean equal columns, but for a chance of some 2^-64. Numbers are compared
    as doubles, minus zero is zero, and all NaN are one.
    """
    kinds = {c: "number" if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or t.startswith("decimal") else t for c, t in df.dtypes}
    own = F.xxhash64(*[F.col(f"`{c}`") for c in rows])

    def value(c: str):
        x = F.col(f"`{c}`").cast("double") + F.lit(0.0) if kinds[c] == "number" else F.col(f"`{c}`")
        return F.xxhash64(F.lit(7), "_row", x, x.isNull())

    sums = df.withColumn("_row", own).agg(*[F.sum(value(c).cast("decimal(20,0)")).alias(f"c{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.col(f"c{i}").cast("string").alias("fingerprint")) for i, c in enumerate(cols)])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def drop_equal(df: DataFrame, cols: list[str], rows: list[str]) -> list[str]:
    """The columns that stay: of those that are equal in all rows, the first."""
    first: dict[tuple, str] = {}
    found = {r.column_name: (r.kind, r.fingerprint) for r in column_fingerprints(df, cols, rows).collect()} if cols else {}  # a row a column
    for c in cols:
        first.setdefault(found[c], c)
    return [c for c in cols if first[found[c]] == c]

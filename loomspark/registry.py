"""The library's queries by name, with SQL that says the same; numbers are rounded alike on both sides."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_more, registry_reports, registry_sources, registry_store
from .operators import attribution, binning, categorical, domain, polynomial, quality, ranking, sampling, statistical, temporal, text
from .plans import analytics
from .streaming import windows


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6, own: dict[str, int] | None = None) -> DataFrame:
    """Doubles rounded once, to their own digits if named, and whole numbers as longs."""
    def one(c: str, t: str):
        x = F.col(f"`{c}`")
        if t in ("double", "float"):
            return F.round(x.cast("double"), (own or {}).get(c, digits)).alias(c)
        return x.cast("long").alias(c) if t in ("int", "smallint", "tinyint") else x

    return df.select(*[one(c, t) for c, t in df.dtypes])


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _num(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


def _int(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _flag(x: str) -> str:
    return f"CAST(CASE WHEN {x} THEN 1 ELSE 0 END AS BIGINT)"


_W = "OVER (PARTITION BY l_returnflag)"


@_query(
    "statistical_features",
    f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, {_num(f'avg(l_quantity) {_W}')} AS l_quantity_mean_by_l_returnflag, {_num(f'coalesce(stddev_samp(l_quantity) {_W}, 0)')} AS l_quantity_std_by_l_returnflag, "
    f"{_int(f'count(l_quantity) {_W}')} AS l_quantity_count_by_l_returnflag, {_num(f'min(l_quantity) {_W}')} AS l_quantity_min_by_l_returnflag, {_num(f'max(l_quantity) {_W}')} AS l_quantity_max_by_l_returnflag, "
    f"{_num(f'l_quantity - avg(l_quantity) {_W}')} AS l_quantity_dev_from_l_returnflag_mean, {_num(f'(l_quantity - min(l_quantity) {_W}) / (max(l_quantity) {_W} - min(l_quantity) {_W})')} AS l_quantity_norm_by_l_returnflag FROM lineitem",
)
def _statistical(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double"), "l_returnflag")
    return _rounded(statistical.statistical_features(df, ["l_returnflag"], ["l_quantity"]).withColumn("l_linenumber", F.col("l_linenumber").cast("int")))


@_query("group_zscore", f"SELECT o_orderkey, {_num('(o_totalprice - avg(o_totalprice) OVER w) / (coalesce(stddev_samp(o_totalprice) OVER w, 0) + 0.00001)')} AS o_totalprice_zscore_by_o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def _zscore(spark, d):
    return _rounded(statistical.group_zscore(_t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderpriority", "o_totalprice").drop("o_totalprice", "o_orderpriority"))


@_query(
    "polynomial_features",
    f"SELECT l_orderkey, {_num('l_quantity * l_quantity')} AS l_quantity_squared, {_num('l_quantity * l_quantity * l_quantity')} AS l_quantity_cubed, {_num('CASE WHEN l_quantity > 0 THEN ln(1 + l_quantity) ELSE 0 END')} AS l_quantity_log, {_num('sqrt(l_quantity)')} AS l_quantity_sqrt, "
    f"{_num('CASE WHEN abs(l_quantity) > 1e-10 THEN 1 / l_quantity ELSE 0 END')} AS l_quantity_reciprocal, {_num('l_tax * l_tax')} AS l_tax_squared, {_num('l_tax * l_tax * l_tax')} AS l_tax_cubed, {_num('CASE WHEN l_tax > 0 THEN ln(1 + l_tax) ELSE 0 END')} AS l_tax_log, {_num('sqrt(l_tax)')} AS l_tax_sqrt, "
    f"{_num('CASE WHEN abs(l_tax) > 1e-10 THEN 1 / nullif(l_tax, 0) ELSE 0 END')} AS l_tax_reciprocal, {_num('l_quantity * l_tax')} AS l_quantity_x_l_tax FROM lineitem",
)
def _polynomial(spark, d):
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return _rounded(polynomial.polynomial_features(df, ["l_quantity", "l_tax"], degree=3).drop("l_quantity", "l_tax"))


@_query("arithmetic_features", f"SELECT l_orderkey, {_num('l_quantity + l_tax')} AS l_quantity_plus_l_tax, {_num('l_quantity - l_tax')} AS l_quantity_minus_l_tax, {_num('l_quantity * l_tax')} AS l_quantity_times_l_tax, {_num('l_quantity / nullif(l_tax, 0)')} AS l_quantity_div_l_tax, {_num('l_quantity / nullif(l_quantity + l_tax, 0)')} AS l_quantity_ratio_sum_l_tax FROM lineitem")
def _arithmetic(spark, d):
    return _rounded(polynomial.arithmetic_features(_t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), "l_quantity", "l_tax").drop("l_quantity", "l_tax"))


_EDGES = "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM orders)"


@_query(
    "quantile_bins",
    _EDGES + f", b AS (SELECT o_orderkey, {_int('CASE WHEN o_totalprice <= q[2] THEN 0 WHEN o_totalprice <= q[3] THEN 1 WHEN o_totalprice <= q[4] THEN 2 WHEN o_totalprice <= q[5] THEN 3 ELSE 4 END')} AS o_totalprice_qbin_5 FROM orders, e) SELECT *, " + ", ".join(f"{_flag(f'o_totalprice_qbin_5 = {k}')} AS o_totalprice_is_bin_{k}" for k in range(5)) + " FROM b",
)
def _qbins(spark, d):
    return _rounded(binning.binning_features(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice"))


@_query("uniform_bins", f"WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 5.0 AS w FROM lineitem) SELECT l_orderkey, l_quantity, {_int('least(greatest(ceil((l_quantity - lo) / w) - 1, 0), 4)')} AS l_quantity_ubin_5 FROM lineitem, e")
def _ubins(spark, d):
    return _rounded(binning.binning_features(_t(spark, d, "lineitem").select("l_orderkey", "l_quantity"), ["l_quantity"], strategy="uniform", dummies=False))


@_query(
    "ranking_features",
    f"WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, median(l_extendedprice) AS md, count(*) AS n, list_sort(list_distinct(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]))) AS q4, list_sort(list_distinct(quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q10 FROM lineitem), "
    "r AS (SELECT l_extendedprice AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r, dense_rank() OVER (ORDER BY l_extendedprice) AS dr FROM lineitem), m AS (SELECT max(r) AS mr FROM r) "
    f"SELECT {_num('x')} AS l_extendedprice, {_num('r')} AS l_extendedprice_rank, {_num('dr')} AS l_extendedprice_dense_rank, {_num('r / n')} AS l_extendedprice_percentile, {_num('(r - 1) / (mr - 1)')} AS l_extendedprice_norm_rank, {_flag('r / n >= 0.9')} AS l_extendedprice_is_top10pct, {_flag('r / n <= 0.1')} AS l_extendedprice_is_bottom10pct, "
    f"{_flag('x > md')} AS l_extendedprice_above_median, {_num('1 / (1 + exp(-((x - m.m) / sd) / 2))'.replace('m.m', 's.m'))} AS l_extendedprice_zscore_rank, {_int('len(list_filter(q4[2:4], lambda e: e < x))')} AS l_extendedprice_quartile, {_int('len(list_filter(q10[2:10], lambda e: e < x))')} AS l_extendedprice_decile FROM r, s, m",
)
def _ranking(spark, d):
    return _rounded(ranking.ranking_features(_t(spark, d, "lineitem").select("l_extendedprice"), ["l_extendedprice"]))


@_query("group_percent_rank", f"SELECT l_returnflag, l_quantity, {_num('(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0) / count(*) OVER (PARTITION BY l_returnflag)')} AS l_quantity_pct_rank_by_l_returnflag FROM lineitem")
def _pct_rank(spark, d):
    return _rounded(ranking.group_percent_rank(_t(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity"))


def _calendar_sql(c: str, table: str, key: str, ref: str) -> str:
    p = {"year": f"year({c})", "month": f"month({c})", "day": f"day({c})", "quarter": f"quarter({c})", "hour": f"hour({c})", "minute": f"minute({c})", "dayofyear": f"dayofyear({c})", "dayofweek": f"isodow({c}) - 1", "weekofyear": f"week({c})"}
    out = [f"{_int(v)} AS {c}_{k}" for k, v in p.items()]
    for k, period in (("month", 12), ("day", 31), ("dayofweek", 7), ("hour", 24)):
        out += [f"{_num(f'{f}(2 * pi() * ({p[k]}) / {period})')} AS {c}_{k}_{f}" for f in ("sin", "cos")]
    end = f"day({c}) = day(last_day({c}))"
    flags = {"is_weekend": f"isodow({c}) >= 6", "is_month_start": f"day({c}) = 1", "is_month_end": end, "is_quarter_start": f"day({c}) = 1 AND month({c}) IN (1, 4, 7, 10)", "is_quarter_end": f"{end} AND month({c}) IN (3, 6, 9, 12)", "is_year_start": f"month({c}) = 1 AND day({c}) = 1", "is_year_end": f"month({c}) = 12 AND day({c}) = 31"}
    out += [f"{_flag(v)} AS {c}_{k}" for k, v in flags.items()]
    secs = f"CAST(floor(epoch({c})) AS BIGINT)"
    now = f"CAST(epoch(TIMESTAMP '{ref}') AS BIGINT)"
    out += [f"{secs} AS {c}_timestamp", f"{_int(f'floor(({now} - {secs}) / 86400.0)')} AS {c}_days_since_today", f"{_flag(f'{secs} > {now}')} AS {c}_is_future"]
    return f"SELECT {key}, {', '.join(out)} FROM {table}"


@_query("calendar_features", _calendar_sql("o_orderdate", "orders", "o_orderkey", "1998-01-01 00:00:00"))
def _calendar(spark, d):
    return _rounded(temporal.calendar_features(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-01-01 00:00:00").drop("o_orderdate"))


_S = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@_query(
    "series_features",
    "SELECT event_id, " + ", ".join(f"{_num(f'lag(value, {k}) {_S})')} AS value_lag_{k}" for k in (1, 2, 3)) + ", "
    + ", ".join(f"{_num(f'coalesce({f}(value) {_S} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 0)')} AS value_rolling_{n}_{w}" for w in (3, 7) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + ", " + ", ".join(f"{_num(f'coalesce({f}(value) {_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 9)} AS value_{n}" for n, f in (("expanding_mean", "avg"), ("expanding_std", "stddev_samp"), ("cumsum", "sum"))) + " FROM events",
)
def _series(spark, d):
    df = temporal.series_features(_t(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"], expanding=True).drop("user_id", "ts", "value")
    more = [c for c in df.columns if "expanding" in c or "cumsum" in c]
    return df.select(*[F.round(c, 9 if c in more else 6).alias(c) if t == "double" else c for c, t in df.dtypes])


_ONE = "OVER (ORDER BY ts, event_id"


@_query(
    "series_of_all_rows",
    "SELECT event_id, " + ", ".join(f"{_num(f'lag(value, {k}) {_ONE})')} AS value_lag_{k}" for k in (1, 5)) + ", "
    + ", ".join(f"{_num(f'coalesce({f}(value) {_ONE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0)')} AS value_rolling_{n}_6" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + ", " + ", ".join(f"{_num(f'coalesce({f}(value) {_ONE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', digits)} AS value_{n}" for n, f, digits in (("expanding_mean", "avg", 6), ("expanding_std", "stddev_samp", 4), ("cumsum", "sum", 4))) + " FROM events",
)
def _one_series(spark, d):
    df = temporal.series_features(_t(spark, d, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], [], lags=(1, 5), windows=(6,), expanding=True, most=2_000)
    return _rounded(df.drop("ts", "value"), own={"value_expanding_std": 4, "value_cumsum": 4})


def _plain(rx: str) -> str:
    """A pattern without looks around, for finding whether a text has it."""
    return rx.replace("(?<![a-z0-9._%+-])", "").replace("(?<![A-Za-z0-9_])", "(^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "([^A-Za-z0-9_]|$)")


def _text_sql(c: str, table: str, key: str) -> str:
    n, ws = f"length({c})", f"list_filter(string_split_regex({c}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
    def cnt(rx: str) -> str:
        return f"({n} - length(regexp_replace({c}, '{rx}', '', 'g')))"
    kinds = {"digit": "[0-9]", "upper": "[A-Z]", "lower": "[a-z]", "space": r"[ \t\n\r\f\v]", "punctuation": r"[^A-Za-z0-9_ \t\n\r\f\v]", "special_char": r"[^a-zA-Z0-9 \t\n\r\f\v]"}
    out = [f"{_int(n)} AS {c}_length", f"{_int(f'len({ws})')} AS {c}_word_count", f"{_num(f'CASE WHEN len({ws}) > 0 THEN ({n} - {cnt(kinds["space"])}) / CAST(len({ws}) AS DOUBLE) ELSE 0 END')} AS {c}_avg_word_length"]
    out += [f"{_int(cnt(v))} AS {c}_{k}_count" for k, v in kinds.items()]
    out += [f"{_num(f'{cnt(kinds[k])} / CAST(greatest({n}, 1) AS DOUBLE)')} AS {c}_{k}_ratio" for k in ("digit", "upper", "lower", "punctuation", "space")]
    sent = f"len(regexp_extract_all({c}, '[.!?]+'))"
    uniq = f"len(list_distinct(list_filter(string_split_regex(lower({c}), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')))"
    out += [f"{_int(sent)} AS {c}_sentence_count", f"{_int(cnt('[?]'))} AS {c}_question_count", f"{_int(cnt('[!]'))} AS {c}_exclamation_count", f"{_int(uniq)} AS {c}_unique_word_count", f"{_num(f'{uniq} / CAST(greatest(len({ws}), 1) AS DOUBLE)')} AS {c}_vocabulary_richness"]
    par, quo = cnt("[()]"), cnt("[\"'']")
    out += [f"{_int(par)} AS {c}_parentheses_count", f"{_int(quo)} AS {c}_quote_count", f"{_num(f'len({ws}) / CAST(greatest({sent}, 1) AS DOUBLE)')} AS {c}_avg_sentence_length"]
    chars = f"list_distinct(string_split({c}, ''))"
    share = f"({n} - length(replace({c}, ch, ''))) / CAST({n} AS DOUBLE)"
    out += [f"{_num(f"CASE WHEN {n} = 0 THEN 0 ELSE -list_sum(list_transform(list_filter({chars}, lambda ch: ch <> ''), lambda ch: {share} * log2({share}))) END", 5)} AS {c}_char_entropy"]
    flags = {"is_empty": f"{n} = 0", "has_question": f"contains({c}, '?')", "is_numeric": f"regexp_full_match({c}, '[0-9]+')", "is_alpha": f"regexp_full_match({c}, '\\p{{L}}+')", "is_alphanumeric": f"regexp_full_match({c}, '[\\p{{L}}\\p{{N}}]+')", "starts_with_capital": f"regexp_matches({c}, '^\\p{{Lu}}')", "is_all_caps": f"upper({c}) = {c} AND lower({c}) <> {c}", "is_all_lower": f"lower({c}) = {c} AND upper({c}) <> {c}"}
    flags |= {f"has_{k}": f"regexp_matches({c}, '{_plain(rx)}')" for k, rx in text.PATTERNS.items()}
    out += [f"{_flag(t)} AS {c}_{k}" for k, t in flags.items()]
    out += [f"{_int(f"len(regexp_extract_all({c}, '{x}[A-Za-z0-9_]'))")} AS {c}_{k}_count" for k, x in (("hashtag", "#"), ("mention", "@"))]
    return f"SELECT {key}, {', '.join(out)} FROM {table}"


@_query("text_features", _text_sql("text", "documents", "doc_id"))
def _text(spark, d):
    from .sources.tables import spread

    return _rounded(text.text_features(spread(_t(spark, d, "documents").select("doc_id", "text")), "text").drop("text"), own={"text_char_entropy": 5})


@_query("text_entropy", f"WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS k FROM c GROUP BY p_partkey, ch), t AS (SELECT *, sum(k) OVER (PARTITION BY p_partkey) AS total FROM n) SELECT p_partkey, {_num('-sum(k / total * log2(k / total))')} AS p_name_char_entropy FROM t GROUP BY p_partkey")
def _entropy(spark, d):
    return _rounded(text.text_features(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "p_name_char_entropy"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@_query(
    "tf_idf",
    f"WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS term FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM d), "
    "c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term), k AS (SELECT term, count(*) AS docs, sum(n) AS uses FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY uses DESC, term LIMIT 100), w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + docs AS DOUBLE)) + 1) AS w FROM c JOIN k USING (term)) "
    f"SELECT doc_id, term, {_num('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w",
)
def _tf_idf(spark, d):
    return _rounded(text.tf_idf(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@_query(
    "categorical_features",
    "WITH c AS (SELECT o_orderstatus AS v, count(*) AS n, avg(o_totalprice) AS m, coalesce(var_samp(o_totalprice), 0) AS s FROM orders GROUP BY o_orderstatus), t AS (SELECT count(*) AS total, avg(o_totalprice) AS m FROM orders), "
    "r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) - 1 AS rk, row_number() OVER (ORDER BY v) - 1 AS lb FROM c) "
    f"SELECT o_orderkey, o_orderstatus, {_num('n / CAST(total AS DOUBLE)')} AS o_orderstatus_frequency, {_int('n')} AS o_orderstatus_count, {_int('rk')} AS o_orderstatus_frequency_rank, {_int('lb')} AS o_orderstatus_label_encoded, {_num('(r.m * n + t.m * 1.0) / (n + 1.0)', 4)} AS o_orderstatus_target_encoded, {_num('s / 1e6', 4)} AS o_orderstatus_target_variance_m, {_int('lb & 1')} AS o_orderstatus_binary_bit_0, {_int('(lb >> 1) & 1')} AS o_orderstatus_binary_bit_1 FROM orders JOIN r ON o_orderstatus = v, t",
)
def _categorical(spark, d):
    df = categorical.categorical_features(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice", max_onehot=0, bits=True).drop("o_totalprice")
    df = df.withColumn("o_orderstatus_target_variance_m", F.col("o_orderstatus_target_variance") / 1e6).drop("o_orderstatus_target_variance")
    return _rounded(df, own={c: 4 for c in ("o_orderstatus_target_encoded", "o_orderstatus_target_variance_m")})


@_query("onehot_features", "SELECT o_orderkey, " + ", ".join(f"""{_flag(f"o_orderpriority = '{v}'")} AS "o_orderpriority_is_{v.replace(' ', '_').replace('-', '_')}\"""" for v in _PRIORITIES) + " FROM orders")
def _onehot(spark, d):
    df = categorical.categorical_features(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    return _rounded(df.select("o_orderkey", *[c for c in df.columns if "_is_" in c]))


@_query("combination_features", f"SELECT l_orderkey, l_returnflag || '_' || l_linestatus AS l_returnflag_l_linestatus_combination, {_num('count(*) OVER (PARTITION BY l_returnflag, l_linestatus) / CAST(count(*) OVER () AS DOUBLE)')} AS l_returnflag_l_linestatus_combination_frequency FROM lineitem")
def _combination(spark, d):
    return _rounded(categorical.combination_features(_t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus").drop("l_returnflag", "l_linestatus"))


@_query("rare_categories", f"SELECT p_partkey, {_flag('count(*) OVER (PARTITION BY p_brand) < 0.04 * count(*) OVER ()')} AS p_brand_is_rare FROM part")
def _rare(spark, d):
    return _rounded(categorical.rare_flags(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.04).drop("p_brand"))


@_query("group_impute", f"WITH j AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), m AS (SELECT lang, median(quality) AS q FROM j GROUP BY lang) SELECT doc_id, {_num('coalesce(quality, q, (SELECT median(quality) FROM j))')} AS quality, {_flag('quality IS NULL')} AS quality_was_missing FROM j JOIN m USING (lang)")
def _impute(spark, d):
    df = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id", F.col("quality").cast("double")), "doc_id", "left")
    return _rounded(quality.group_impute(quality.missing_indicators(df, ["quality"]), "quality", ["lang"]).drop("lang"))


@_query(
    "outlier_features",
    f"WITH s AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b, quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer) SELECT c_custkey, {_flag('c_acctbal < a - 0.2 * (b - a) OR c_acctbal > b + 0.2 * (b - a)')} AS c_acctbal_is_outlier_iqr, "
    f"{_num('least(greatest(c_acctbal, a - 0.2 * (b - a)), b + 0.2 * (b - a))')} AS c_acctbal_capped_iqr, {_num('least(greatest(c_acctbal, lo), hi)')} AS c_acctbal_capped_pct, {_flag('abs(c_acctbal - m) > 1.5 * sd')} AS c_acctbal_is_outlier_z FROM customer, s",
)
def _outliers(spark, d):
    return _rounded(quality.outlier_features(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], iqr=0.2, z=1.5).drop("c_acctbal"))


@_query("validate_table", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_int(f'count(*) FILTER ({c} IS NULL)')} AS n_null, {_int(f'count(*) FILTER (isnan(CAST({c} AS DOUBLE)))')} AS n_nan, {_int(f'count(*) FILTER (isinf(CAST({c} AS DOUBLE)))')} AS n_inf, {_int(f'count(*) FILTER ({c} = 0)')} AS n_zero, {_int(f'count(*) FILTER ({c} < 0)')} AS n_negative, {_int(f'count(*) FILTER (abs({c}) > 1e10)')} AS n_extreme FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def _validate(spark, d):
    return _rounded(quality.validate(_t(spark, d, "customer")))


@_query("correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_num(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def _correlations(spark, d):
    return _rounded(quality.correlations(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@_query("stratified_k", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 10")
def _stratified_k(spark, d):
    return sampling.per_stratum(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 10, ["o_orderkey"])


@_query("stratified_share", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS t FROM orders) WHERE r <= greatest(1, floor(500 * n / CAST(t AS DOUBLE)))")
def _stratified_share(spark, d):
    return sampling.proportional(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 500, ["o_orderkey"])


@_query("sample_exactly")
def _sample(spark, d):
    return sampling.exactly(_t(spark, d, "orders"), 100, ["o_orderkey"])


@_query("sample_bernoulli")
def _bernoulli(spark, d):
    return sampling.bernoulli(_t(spark, d, "orders"), 0.1, ["o_orderkey"])


_NAMES = "rice,wheat,maize,cotton,jute,coffee,coconut,papaya,orange,apple,muskmelon,watermelon,grapes,mango,banana,pomegranate,lentil,blackgram,mungbean,mothbeans,pigeonpeas,kidneybeans,chickpea,quinoa"
_CROPS = f"SELECT p_partkey, CAST(p_partkey % 45 AS DOUBLE) AS temperature, CAST(p_size * 2 AS DOUBLE) AS humidity, 4.0e0 + (p_partkey % 50) / 10.0e0 AS ph, CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_retailprice / 8 END AS rainfall, split_part('{_NAMES}', ',', CAST(1 + p_partkey % 24 AS INT)) AS crop_name, CAST(p_partkey % 90 AS DOUBLE) AS n, CAST(p_partkey % 60 AS DOUBLE) AS p, CAST(p_size AS DOUBLE) AS k FROM part"
# crop, least and greatest temperature, least and greatest rainfall (of the crops that have one), acidity
_NEEDS = """(VALUES ('apple', 21, 24, NULL, NULL), ('banana', 20, 35, 100, 200), ('blackgram', 25, 35, NULL, NULL), ('chickpea', 10, 35, -1, 99.9999999), ('coconut', 20, 32, 200.0000001, 1e9), ('coffee', 18, 28, NULL, NULL), ('cotton', 21, 32, 100, 200),
 ('grapes', 15, 35, NULL, NULL), ('jute', 24, 37, 200.0000001, 1e9), ('kidneybeans', 10, 27, NULL, NULL), ('lentil', 18, 30, -1, 99.9999999), ('maize', 18, 32, 100, 200), ('mango', 24, 35, NULL, NULL), ('mothbeans', 24, 32, -1, 99.9999999), ('mungbean', 25, 35, -1, 99.9999999),
 ('muskmelon', 25, 35, NULL, NULL), ('orange', 13, 35, NULL, NULL), ('papaya', 21, 33, 100, 200), ('pigeonpeas', 18, 35, NULL, NULL), ('pomegranate', 25, 35, NULL, NULL), ('rice', 20, 35, 200.0000001, 1e9), ('watermelon', 25, 35, NULL, NULL), ('wheat', 12, 25, NULL, NULL)) AS need(crop, t0, t1, r0, r1)"""


def _div(a: str, b: str) -> str:
    return f"({a}) / CASE WHEN abs({b}) < 1e-10 THEN 1e-10 ELSE {b} END"


_STRESS = "(CASE WHEN n < 40 THEN 1 ELSE 0 END + CASE WHEN p < 20 THEN 1 ELSE 0 END + CASE WHEN k < 20 THEN 1 ELSE 0 END + CASE WHEN greatest(n, p, k) > 0.6 * (n + p + k + 1e-6) THEN 1 ELSE 0 END)"
_GROW = "(4 - abs(temperature - 25) / 20 - abs(humidity - 55) / 45 - abs(ph - 7) / 3 - 1 + least(greatest(rainfall, 0), 200) / 200) / 4"
_CV = _div("sqrt((n * n + p * p + k * k - (n + p + k) * (n + p + k) / 3) / 2)", "((n + p + k) / 3)")


@_query(
    "crop_features",
    f"WITH c AS ({_CROPS}), d AS (SELECT c.*, need.* FROM c LEFT JOIN {_NEEDS} ON crop_name = crop) SELECT p_partkey, temperature, humidity, ph, {_num('rainfall')} AS rainfall, crop_name, n AS \"N\", p AS \"P\", k AS \"K\", "
    + ", ".join(f"{_flag(t)} AS {n}" for n, t in {
        "temp_stress_extreme_cold": "temperature < 15", "temp_stress_cold": "temperature >= 15 AND temperature <= 20", "temp_stress_optimal": "temperature >= 20 AND temperature <= 30", "temp_stress_hot": "temperature >= 30 AND temperature <= 35", "temp_stress_extreme_hot": "temperature > 35",
        "humidity_stress_low": "humidity < 40", "humidity_stress_optimal": "humidity >= 40 AND humidity <= 70", "humidity_stress_high": "humidity > 70", "ph_stress_acidic": "ph < 5.5", "ph_stress_slightly_acidic": "ph >= 5.5 AND ph <= 6.5", "ph_stress_neutral": "ph >= 6.5 AND ph <= 7.5", "ph_stress_alkaline": "ph > 7.5",
        "water_stress_severe": "rainfall < 50", "water_stress_moderate": "rainfall >= 50 AND rainfall <= 100", "water_stress_none": "rainfall > 100", "rice_ph_suitable": "crop_name = 'rice' AND ph >= 5.5 AND ph <= 7", "wheat_ph_suitable": "crop_name = 'wheat' AND ph >= 6 AND ph <= 7.5", "cotton_ph_suitable": "crop_name = 'cotton' AND ph >= 5.8 AND ph <= 8.2",
        "crop_temp_suitability": "temperature BETWEEN t0 AND t1", "crop_water_match": "rainfall BETWEEN r0 AND r1", "low_total_nutrients": "n + p + k < 150", "low_nitrogen": "n < 40", "low_phosphorus": "p < 20", "low_potassium": "k < 20",
        "n_predominant": "n >= greatest(p, k)", "p_predominant": "p > n AND p >= k", "k_predominant": "k > greatest(n, p)", "severely_imbalanced": "greatest(n, p, k) > 0.6 * (n + p + k + 1e-6)", "npk_balanced": "greatest(n, p, k) < 0.5 * (n + p + k)", "npk_highly_imbalanced": "greatest(n, p, k) > 0.7 * (n + p + k)",
    }.items())
    + f", {_num('(abs(temperature - 25) / 10 + abs(humidity - 55) / 15) / 2')} AS environmental_stress_score, {_num(_div('n', 'p'), 4)} AS n_to_p_ratio, {_num(_div('n', 'k'), 4)} AS n_to_k_ratio, {_num(_div('p', 'k'), 4)} AS p_to_k_ratio, {_num(_CV)} AS nutrient_imbalance_score, CASE WHEN n >= greatest(p, k) THEN 'N' WHEN p >= k THEN 'P' ELSE 'K' END AS predominant_nutrient, "
    f"{_num(_GROW, 9)} AS growing_condition_score, CASE WHEN n >= 40 AND p >= 20 AND k >= 20 THEN 'balanced' ELSE concat_ws('_', CASE WHEN n < 40 THEN 'N' END, CASE WHEN p < 20 THEN 'P' END, CASE WHEN k < 20 THEN 'K' END, 'deficient') END AS fertilizer_need_pattern, 0.0e0 AS crop_environment_match, {_num(f'{_GROW} * (1 - {_CV})', 9)} AS npk_utilization_efficiency, "
    f"{_int(_STRESS)} AS stress_factor_count, CASE {_STRESS} WHEN 0 THEN 'simple' WHEN 1 THEN 'simple' WHEN 4 THEN 'complex' ELSE 'moderate' END AS recommendation_complexity FROM d",
)
def _crops(spark, d):
    _t(spark, d, "part").createOrReplaceTempView("part")
    # scores are sums of few decimals: nine digits hold them whole, so that none is halfway between two
    own = {c: 4 for c in ("n_to_p_ratio", "n_to_k_ratio", "p_to_k_ratio")} | {c: 9 for c in ("growing_condition_score", "npk_utilization_efficiency")}
    return _rounded(domain.domain_features(spark.sql(_CROPS).withColumnsRenamed({"n": "N", "p": "P", "k": "K"})), own=own)


_PEOPLE = """SELECT c_custkey, CAST(1 + c_nationkey % 3 AS INT) AS pclass, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 80 AS DOUBLE) END AS age, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 0e0 ELSE abs(c_acctbal) / 20 END AS fare,
 CAST(c_custkey % 3 AS INT) AS sibsp, CAST(c_custkey % 4 AS INT) AS parch, c_name || ', ' || split_part('Mr,Miss,Mrs,Master,Dr,Rev,Mlle,Mme,Ms,Lady', ',', CAST(1 + c_custkey % 10 AS INT)) || '. Ann' AS name, CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE split_part('A1,B20 B22,C85,D,E101 E102 E103,F2,G6,T,7', ',', CAST(1 + c_custkey % 9 AS INT)) END AS cabin,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE split_part('S,C,Q,S', ',', CAST(1 + c_custkey % 4 AS INT)) END AS embarked, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer"""


@_query(
    "passenger_features",
    f"WITH c AS ({_PEOPLE}), m AS (SELECT pclass, median(age) AS ma, avg(fare) AS mean FROM c GROUP BY pclass), s AS (SELECT median(fare) AS mf, median(age) AS mall FROM c), x AS (SELECT c.*, coalesce(age, ma) AS af, coalesce(fare, mf) AS ff, coalesce(age, mall) AS ag, mean, sibsp + parch + 1 AS fs, trim(split_part(split_part(name, ',', 2), '.', 1)) AS t, coalesce(embarked, 'S') AS port FROM c JOIN m USING (pclass), s), "
    "y AS (SELECT *, CASE WHEN t = 'Mr' THEN 'Mr' WHEN t IN ('Mrs', 'Mme') THEN 'Mrs' WHEN t IN ('Miss', 'Mlle', 'Ms') THEN 'Miss' WHEN t = 'Master' THEN 'Master' ELSE 'Rare' END AS title, CASE WHEN regexp_matches(cabin, '^[A-Z]') THEN left(cabin, 1) ELSE 'Unknown' END AS cabin_deck, CASE WHEN cabin IS NULL THEN 0 ELSE len(string_split(cabin, ' ')) END AS rooms, CASE WHEN fs <= 1 THEN 'alone' WHEN fs <= 4 THEN 'small' ELSE 'large' END AS fam FROM x) "
    f"SELECT c_custkey, {_int('pclass')} AS pclass, {_num('age')} AS age, {_num('fare')} AS fare, {_int('sibsp')} AS sibsp, {_int('parch')} AS parch, name, cabin, embarked, sex, CAST(pclass AS VARCHAR) AS pclass_cat, {_int('fs')} AS family_size, fam AS family_size_binned, {_num('af')} AS age_filled, CASE WHEN af <= 0 THEN NULL WHEN af <= 16 THEN 'child' WHEN af <= 35 THEN 'young_adult' WHEN af <= 60 THEN 'middle_age' ELSE 'elderly' END AS age_group, "
    f"{_num('ff')} AS fare_filled, {_num('ln(1 + ff)')} AS fare_log, CASE WHEN ff <= 0 THEN NULL WHEN ff <= 7.91 THEN 'low' WHEN ff <= 14.45 THEN 'medium' WHEN ff <= 31 THEN 'high' ELSE 'very_high' END AS fare_category, {_num('coalesce(fare / (mean + 1e-6), 0)')} AS fare_vs_class_mean, title, {_int('length(name)')} AS name_length, cabin_deck, {_int('rooms')} AS num_cabins, port AS embarked_filled, "
    "sex || '_' || CASE WHEN ag <= 0 THEN 'nan' WHEN ag <= 16 THEN 'child' WHEN ag <= 35 THEN 'adult' ELSE 'elderly' END AS sex_age_interaction, pclass || '_' || fam AS class_family_interaction, sex || '_class' || pclass AS sex_class_interaction, "
    + ", ".join(f"{_flag(t)} AS {n}" for n, t in {
        "is_first_class": "pclass = 1", "is_third_class": "pclass = 3", "is_alone": "fs = 1", "is_small_family": "fs IN (2, 3, 4)", "is_large_family": "fs > 4", "has_siblings_spouses": "sibsp > 0", "has_parents_children": "parch > 0", "is_child": "af <= 16", "is_adult": "af >= 17 AND af <= 65", "is_elderly": "af > 65",
        "age_was_missing": "age IS NULL", "paid_no_fare": "ff = 0", "expensive_ticket": "ff > 50", "is_mr": "title = 'Mr'", "is_mrs": "title = 'Mrs'", "is_miss": "title = 'Miss'", "is_master": "title = 'Master'", "has_rare_title": "title = 'Rare'", "has_cabin": "cabin IS NOT NULL", "multiple_cabins": "rooms > 1",
        "embarked_c": "port = 'C'", "embarked_q": "port = 'Q'", "embarked_s": "port = 'S'",
    }.items()) + ", " + ", ".join(f"{_flag(f"cabin_deck = '{x}'")} AS deck_{x.lower()}" for x in "ABCDEFG") + " FROM y",
)
def _people(spark, d):
    _t(spark, d, "customer").createOrReplaceTempView("customer")
    return _rounded(domain.domain_features(spark.sql(_PEOPLE)))


_RUNS = "SELECT o_custkey AS run, o_orderpriority AS f, o_totalprice / 1000000 AS s FROM orders"


@_query(
    "feature_attribution",
    f"WITH r AS ({_RUNS}), s AS (SELECT run, max(s) AS s FROM r GROUP BY run), u AS (SELECT DISTINCT run, f FROM r), a AS (SELECT f, avg(s.s) AS w, count(*) AS n, sum(s.s) AS t FROM u JOIN s USING (run) GROUP BY f), t AS (SELECT count(*) AS tn, sum(s) AS ts FROM s) "
    f"SELECT f AS feature, {_num('w')} AS with_mean, {_num('(ts - t) / nullif(tn - n, 0)')} AS without_mean, {_num('w - coalesce((ts - t) / nullif(tn - n, 0), 0)')} AS effect FROM a, t".replace("(ts - t)", "(ts - a.t)"),
)
def _attribution(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    runs = spark.sql(_RUNS).groupBy("run").agg(F.collect_set("f").alias("features"), F.max("s").alias("score"))
    return _rounded(attribution.marginal(runs))


@_query("map_at_3", f"WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_partkey) AS k, min(l_partkey) OVER (PARTITION BY l_orderkey) AS truth FROM (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey, l_partkey)), a AS (SELECT l_orderkey, coalesce(max(CASE WHEN l_partkey = truth THEN 1.0 / k END), 0) AS ap FROM r WHERE k <= 3 GROUP BY l_orderkey) SELECT {_num('avg(ap)')} AS map3 FROM a")
def _map3(spark, d):
    df = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"))
    truth = df.groupBy("l_orderkey").agg(F.min("l_partkey").alias("truth"))
    return _rounded(domain.map_at_3(df.join(truth, "l_orderkey"), "l_orderkey", "l_partkey", "truth", "s"))


@_query("event_windows", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, {_int('count(*)')} AS n, {_num('sum(value)', 4)} AS total FROM events GROUP BY 1, 2")
def _windows(spark, d):
    return windows.windowed(_t(spark, d, "events"), "ts", ["event_type"], "value").withColumn("total", F.round("total", 4))


@_query("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_int('count(*)')} AS n_rows, {_int(f'count(*) - count({c})')} AS n_null, {_int(f'count(DISTINCT {c})')} AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def _column_stats(spark, d):
    from .sources.tables import column_stats

    return _rounded(column_stats(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))


@_query("feature_pipeline")
def _pipeline(spark, d):
    from .plans.pipeline import build

    df = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_tax").alias("tax"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(df, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return build(orders, ["o_orderstatus"], ["quantity", "tax"], target="o_totalprice").data


QUERIES |= registry_store.QUERIES | registry_more.QUERIES | registry_reports.QUERIES | registry_sources.QUERIES
SQL |= registry_store.SQL | registry_more.SQL | registry_reports.SQL | registry_sources.SQL
_GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 5 < 2 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events"


def _gaps(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql(_GAPS)


@_query("impute_fill", f"WITH g AS ({_GAPS}) SELECT event_id, {_num('coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS value FROM g")
def _fill(spark, d):
    return _rounded(quality.impute(_gaps(spark, d), "value", "fill", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


@_query(
    "impute_interpolate",
    f"WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({_GAPS})), n AS (SELECT a.event_id, a.value, a.i, max(b.i) FILTER (b.i <= a.i) AS p, min(b.i) FILTER (b.i >= a.i) AS q, any_value(a.user_id) AS u FROM g a LEFT JOIN g b ON a.user_id = b.user_id AND b.value IS NOT NULL GROUP BY a.event_id, a.value, a.i) "
    f"SELECT n.event_id, {_num('CASE WHEN n.value IS NOT NULL THEN n.value WHEN p IS NULL THEN y.value WHEN q IS NULL THEN x.value ELSE x.value + (y.value - x.value) * (n.i - p) / (q - p) END')} AS value FROM n LEFT JOIN g x ON x.user_id = u AND x.i = p LEFT JOIN g y ON y.user_id = u AND y.i = q",
)
def _interpolate(spark, d):
    return _rounded(quality.impute(_gaps(spark, d), "value", "interpolate", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


_NEAR = "(SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM (" + _GAPS + "))"


@_query(
    "impute_interpolate_all_rows",
    f"WITH g AS {_NEAR}, n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (ORDER BY i) AS p, min(CASE WHEN value IS NOT NULL THEN i END) OVER (ORDER BY i DESC) AS q FROM g) "
    f"SELECT n.event_id, {_num('CASE WHEN n.value IS NOT NULL THEN n.value WHEN p IS NULL THEN y.value WHEN q IS NULL THEN x.value ELSE x.value + (y.value - x.value) * (n.i - p) / (q - p) END', 9)} AS value FROM n LEFT JOIN g x ON x.i = p LEFT JOIN g y ON y.i = q",
)
def _interpolate_all(spark, d):
    return _rounded(quality.impute(_gaps(spark, d).where("event_id is not null"), "value", "interpolate", ["ts", "event_id"], [], most=1_500).select("event_id", "value"), 9)


@_query("impute_mode", f"WITH g AS ({_GAPS}) SELECT event_id, coalesce(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM g")
def _mode(spark, d):
    return quality.impute(_gaps(spark, d), "event_type", "mode").select("event_id", "event_type")


@_query("group_impute_mode", f"WITH g AS ({_GAPS}), m AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM g WHERE event_type IS NOT NULL GROUP BY user_id, event_type) SELECT event_id, coalesce(event_type, t, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM g LEFT JOIN m ON g.user_id = m.user_id AND k = 1")
def _group_mode(spark, d):
    return quality.group_impute(_gaps(spark, d), "event_type", ["user_id"], "mode").select("event_id", "event_type")


@_query("shape_features", f"SELECT o_orderkey, {_num('exp(o_totalprice / 100000)', 4)} AS skewed, {_num('1 + o_orderkey % 5')} AS few, {_num('ln(1 + exp(o_totalprice / 100000))', 4)} AS skewed_log, {_num('exp(o_totalprice / 100000) * exp(o_totalprice / 100000)', 4)} AS skewed_squared FROM orders")
def _shape(spark, d):
    df = _t(spark, d, "orders").select("o_orderkey", F.exp(F.col("o_totalprice") / 100000).alias("skewed"), (1 + F.col("o_orderkey") % 5).cast("double").alias("few"))
    return _rounded(quality.shape_features(df, ["skewed", "few"]), 4)  # the second has too few values, and little skew


@_query("char_codes", f"WITH c AS (SELECT p_partkey, unnest(list_transform(string_split(p_name, ''), lambda ch: CAST(unicode(ch) AS DOUBLE))) AS x FROM part) SELECT p_partkey, {_num('avg(x)')} AS p_name_char_mean, {_num('stddev_pop(x)')} AS p_name_char_std FROM c GROUP BY p_partkey")
def _codes(spark, d):
    return _rounded(text.char_codes(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name").drop("p_name"))


_SETS = "SELECT c_custkey % 60 AS run, c_mktsegment || CAST(c_custkey % 13 AS VARCHAR(9)) AS f, max(c_acctbal) AS s FROM customer WHERE c_custkey % 4 = 1 GROUP BY 1, 2"


@_query(
    "closest_sets",
    f"WITH r AS ({_SETS}), n AS (SELECT run, list(f) AS fs, max(s) AS score FROM r GROUP BY run), p AS (SELECT a.run, b.run AS other, len(list_intersect(a.fs, b.fs)) / CAST(len(list_distinct(list_concat(a.fs, b.fs))) AS DOUBLE) AS j, b.score FROM n a JOIN n b ON a.run <> b.run) "
    f"SELECT run, other, {_num('j')} AS jaccard, {_num('score')} AS other_score FROM p WHERE j > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY j DESC, other) = 1",
)
def _closest(spark, d):
    _t(spark, d, "customer").createOrReplaceTempView("customer")
    runs = spark.sql(_SETS).groupBy("run").agg(F.collect_set("f").alias("features"), F.max("s").alias("score"))
    return _rounded(attribution.closest_set(runs))


_BUYERS = "SELECT o_custkey AS run, unnest(['all', 'm' || CAST(o_orderkey // 4 AS VARCHAR)]) AS f, o_totalprice AS s FROM orders"


@_query(
    "closest_sets_with_a_common_feature",
    f"WITH r AS ({_BUYERS}), n AS (SELECT run, list(DISTINCT f) AS fs, max(s) AS score FROM r GROUP BY run), p AS (SELECT a.run, b.run AS other, len(list_intersect(a.fs, b.fs)) AS k, len(a.fs) + len(b.fs) AS m, b.score FROM n a JOIN n b ON a.run <> b.run) "
    f"SELECT run, other, {_num('k / CAST(m - k AS DOUBLE)')} AS jaccard, {_num('score')} AS other_score FROM p WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY k / CAST(m - k AS DOUBLE) DESC, other) = 1",
)
def _closest_common(spark, d):
    part = F.concat(F.lit("m"), F.floor(F.col("o_orderkey") / 4).cast("string"))
    each = _t(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.explode(F.array(F.lit("all"), part)).alias("f"), "o_totalprice")
    return _rounded(attribution.closest_set(each.groupBy("run").agg(F.collect_set("f").alias("features"), F.max("o_totalprice").alias("score")), frequent=60))


@_query(
    "feature_regression",
    f"WITH r AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS y, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM orders GROUP BY o_custkey), "
    f"c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM r) SELECT '1-URGENT' AS feature, {_num('(bb * ay - ab * byy) / (aa * bb - ab * ab)', 4)} AS effect FROM c UNION ALL SELECT '5-LOW', {_num('(aa * byy - ab * ay) / (aa * bb - ab * ab)', 4)} FROM c",
)
def _regression(spark, d):
    named = F.collect_set(F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), F.col("o_orderpriority")))
    runs = _t(spark, d, "orders").groupBy("o_custkey").agg(named.alias("features"), (F.avg("o_totalprice") / 1000).alias("score"))
    return _rounded(attribution.regression(runs), 4)


@_query("clean_rows", "SELECT DISTINCT t AS note, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'x y' ELSE 'v' || k END AS kind FROM (SELECT trim(regexp_replace(lower(p_type), ' +', ' ', 'g')) AS t, p_partkey % 4 AS k FROM part)")
def _clean(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.element_at(F.array(F.lit("NaN"), F.lit(" none"), F.lit(""), F.lit("NULL")), (F.col("p_partkey") % 3 + 1).cast("int"))).when(k == 1, " X \t y ").otherwise(F.concat(F.lit("V"), k))
    return quality.clean_rows(_t(spark, d, "part").select(F.concat(F.lit("  "), "p_type").alias("note"), raw.alias("kind"), F.lit(None).cast("string").alias("nothing")))


@_query("correlation_pruning", "WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_quantity, l_discount)) AS b, abs(corr(l_extendedprice, l_discount)) AS c FROM lineitem) SELECT 'l_quantity' AS kept FROM c UNION ALL SELECT 'l_extendedprice' FROM c WHERE a <= 0.5 UNION ALL SELECT 'l_discount' FROM c WHERE b <= 0.5 AND c <= 0.5")
def _pruned(spark, d):
    kept = quality.drop_correlated(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 0.5)
    return spark.createDataFrame([(c,) for c in kept], "kept string")


_TWINS = {"same": "l_quantity", "times": "l_quantity * 1.0", "text": "CAST(l_linenumber AS VARCHAR(9))", "other": "CASE WHEN l_orderkey = 7 THEN l_quantity + 1 ELSE l_quantity END", "line": "l_linenumber + 0", "gaps": "CASE WHEN l_tax > 0 THEN l_tax END", "gaps_again": "nullif(l_tax, 0)"}


@_query(
    "equal_columns",
    f"WITH t AS (SELECT l_quantity, l_linenumber, {', '.join(f'{x} AS {n}' for n, x in _TWINS.items())} FROM lineitem) SELECT 'l_quantity' AS kept UNION ALL SELECT 'l_linenumber' UNION ALL SELECT 'text' UNION ALL SELECT 'gaps' "
    + "".join(f" UNION ALL SELECT '{n}' FROM t HAVING " + " AND ".join(f"count(*) FILTER ({n} IS DISTINCT FROM {m}) > 0" for m in ms) for n, ms in {"same": ["l_quantity"], "times": ["l_quantity"], "other": ["l_quantity"], "line": ["l_linenumber"], "gaps_again": ["gaps"]}.items()),
)
def _equal(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    df = spark.sql(f"SELECT l_orderkey, l_linenumber, l_quantity, l_tax, {', '.join(f'{x} AS {n}' for n, x in _TWINS.items())} FROM lineitem")
    kept = quality.drop_equal(df, ["l_quantity", "l_linenumber", *_TWINS], ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])
    return spark.createDataFrame([(c,) for c in kept], "kept string")


@_query("low_variance", " UNION ALL ".join(f"SELECT '{c}' AS kept FROM lineitem HAVING var_samp({c}) > 0.01" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")))
def _low_variance(spark, d):
    kept = quality.drop_low_variance(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 0.01)
    return spark.createDataFrame([(c,) for c in kept], "kept string")


@_query("column_metadata", f"WITH m AS (SELECT 'c_acctbal' AS column_name, {_num('avg(c_acctbal)', 4)} AS mean, {_num('stddev_samp(c_acctbal)', 4)} AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, 0.0e0 AS null_ratio, count(DISTINCT c_acctbal) AS unique_count, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_acctbal)) AS mode_frequency FROM customer UNION ALL SELECT 'c_mktsegment', NULL, NULL, NULL, NULL, 0, count(DISTINCT c_mktsegment), (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) FROM customer) SELECT * FROM m")
def _metadata(spark, d):
    from .sources.tables import column_metadata

    return column_metadata(_t(spark, d, "customer"), ["c_acctbal", "c_mktsegment"]).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@_query("three_way_join", f"SELECT n_name, r_name, {_int('count(*)')} AS n, {_num('avg(c_acctbal)', 4)} AS mean FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name, r_name")
def _three_way(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@_query("semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _semi(spark, d):
    return _t(spark, d, "part").join(_t(spark, d, "lineitem").where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@_query("top_and_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _page(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


for _name in analytics.QUERIES:
    QUERIES[f"analytics_{_name}"] = partial(analytics.run, name=_name)
    SQL[f"analytics_{_name}"] = analytics.sql(_name)

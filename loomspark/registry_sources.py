"""Queries of readers, writers, stored rows, samples, fitted encodings and kernels by name, with SQL of another form beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import clean_numeric, profile, safe_divide
from .operators import binning, dates, quality, ranking, sampling
from .plans import fitted, pipeline
from .sources import drifting, stored, tables
from .sources.feature_cache import FeatureCache
from .storage import workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@_query(
    "csv_to_parquet",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice, {_DAY} AS o_orderdate, 'said \"' || o_orderpriority || '\", then; left' AS note, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS BIGINT) END AS customer FROM orders",
)
def _csv(spark, d):
    """Orders as CSV with upper-case names, quotes and gaps; converted, and read with inferred types."""
    df = _dated(_t(spark, d, "orders")).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.concat(F.lit('said "'), "o_orderpriority", F.lit('", then; left')).alias("note"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END").alias("customer"))
    path = workspace(spark, "csv") + "/orders.csv"
    tables.export(df.toDF(*[c.upper() for c in df.columns]), path, "csv")
    out = tables.to_parquet(spark, path, workspace(spark, "converted"))
    return out.select(F.col("o_orderkey").cast("long"), "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("string"), "note", F.col("customer").cast("long"))


@_query(
    "drifting_files",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(o_totalprice AS VARCHAR) ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END END AS price, "
    "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) + CASE WHEN o_orderkey % 3 = 2 THEN 0.5 ELSE 0 END END AS customer, NULL AS rejected FROM orders UNION ALL SELECT NULL, NULL, NULL, o_orderkey || ',1,2,3' FROM orders WHERE o_orderkey % 97 = 5",
)
def _drift(spark, d):
    """Whole numbers, then doubles, then text in one column over three sets of files; another that one set lacks; lines that are too long."""
    orders, root = _t(spark, d, "orders"), workspace(spark, "drifting")
    whole = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.floor("o_totalprice").alias("PRICE"))
    doubles = orders.where("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), "o_orderkey")
    texts = orders.where("o_orderkey % 3 = 2").select("o_orderkey", (F.col("o_custkey") + F.lit(0.5).cast("double")).alias("customer"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END").alias("price"))
    paths = []
    for name, df in (("whole", whole), ("doubles", doubles), ("texts", texts)):
        paths.append(f"{root}/{name}.csv")
        tables.export(df, paths[-1], "csv")
    paths.append(f"{root}/long.csv")
    orders.where("o_orderkey % 97 = 5").select(F.concat("o_orderkey", F.lit(",1,2,3")).alias("o_orderkey,price")).write.csv(paths[-1], header=True, sep="\x01")
    table, bad = drifting.read(spark, paths)
    return table.select("o_orderkey", "price", "customer", F.lit(None).cast("string").alias("rejected")).unionByName(bad.select(F.col("line").alias("rejected")), allowMissingColumns=True)


@_query(
    "split_tables",
    "SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'train' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n_rows, CAST(CASE WHEN min(o_orderkey % 5) > 0 THEN 4 ELSE 3 END AS BIGINT) AS n_columns, CAST(sum(o_custkey) AS BIGINT) AS customers, true AS has_bytes FROM orders GROUP BY 1",
)
def _splits(spark, d):
    """The files of a data set told apart by their names; rows, columns and bytes of each."""
    orders, root = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), workspace(spark, "splits")
    tables.export(orders.where("o_orderkey % 5 > 0"), f"{root}/Orders_Train.parquet")
    tables.export(orders.where("o_orderkey % 5 = 0").drop("o_totalprice"), f"{root}/orders_test.parquet")
    files, out = tables.split_files(["orders_test.parquet", "Orders_Train.parquet", "notes.txt"]), None
    for split, name in files.items():
        seen = tables.file_profile(spark, f"{root}/{name}")
        one = tables.read_split(spark, {split: f"{root}/{name}"}, split).agg(F.lit(split).alias("split"), F.lit(seen["rows"]).cast("long").alias("n_rows"), F.lit(seen["columns"]).cast("long").alias("n_columns"), F.sum("o_custkey").alias("customers"), F.lit(seen["bytes"] > 0).alias("has_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


@_query(
    "json_rows",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS o_orderpriority, o_totalprice, {_DAY} AS o_orderdate, struct_pack(status := o_orderstatus).status AS status FROM orders WHERE o_orderstatus = 'F'",
)
def _json(spark, d):
    """Rows as JSON, chosen by a path inside it, and restored."""
    df = _dated(_t(spark, d, "orders")).select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END").alias("o_orderpriority"), "o_totalprice", "o_orderdate", F.struct(F.col("o_orderstatus").alias("status")).alias("state"))
    kept = tables.filtered(tables.as_json_rows(df, ["o_orderkey"]), {"data": {"$json": {"$.state.status": "F"}}})
    return tables.from_json_rows(kept, df.schema).select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate", "state.status")


@_query("ids_of_any_form", "SELECT c_custkey, c_mktsegment FROM customer WHERE replace(lower(c_mktsegment), '-', '') = 'building'")
def _same_id(spark, d):
    return tables.filtered(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": {"$id": "Build-ING"}})


_TABLES = {"orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s"}, "customer": {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_mktsegment": "s"}, "events": {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "n", "day": "d"}}


def _kind_sql(table: str, column: str, kind: str) -> str:
    x = "strftime(ts, '%Y-%m-%d')" if kind == "d" else column
    named = "true" if "id" in column else "false"
    rest = {"t": "'datetime'", "d": "'datetime'", "n": f"CASE WHEN count(DISTINCT {x}) < 20 THEN 'categorical' ELSE 'numeric' END", "s": f"CASE WHEN count(DISTINCT {x}) > 0.8 * count({x}) OR avg(length({x})) > 50 THEN 'text' ELSE 'categorical' END"}[kind]
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, CASE WHEN {named} AND count(DISTINCT {x}) > 0.8 * count(*) THEN 'id' ELSE {rest} END AS kind FROM {table}"


@_query("column_kinds", " UNION ALL ".join(_kind_sql(t, c, k) for t, cs in _TABLES.items() for c, k in cs.items()))
def _kinds(spark, d):
    """What each column of three tables is taken for: by type, name, shape and number of values."""
    out = []
    for t, cols in _TABLES.items():
        df = _t(spark, d, t)
        df = df.withColumn("day", F.date_format("ts", "yyyy-MM-dd")) if t == "events" else df
        out += [(t, c, k) for c, k in quality.detect_types(df.select(*cols)).items()]
    return spark.createDataFrame(out, "table_name string, column_name string, kind string")  # a row a column


@_query("migrated_table", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(4 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS batches_again FROM orders")
def _migrated(spark, d):
    """A table copied in batches; started again, nothing is left to do."""
    source = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = stored.StoredTable(spark, workspace(spark, "migrated"), ["o_orderkey"], buckets=8)
    target.create(source.limit(0))
    first, again = (stored.migrate(source, target, "orders", batches=4) for _ in range(2))
    return target.read().withColumns({"batches": F.lit(first).cast("long"), "batches_again": F.lit(again).cast("long")})


@_query("cached_features", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, o_custkey % 7 AS part, 'root; part' AS built FROM orders")
def _cached(spark, d):
    """A kept set of features is taken over by a larger one, which builds what is missing only, and by a later reader."""
    orders, built = _t(spark, d, "orders"), []
    made = {"root": F.round(F.sqrt("o_totalprice"), 6), "part": F.col("o_custkey") % 7}

    def build(names):
        built.append(",".join(names))
        return orders.select("o_orderkey", *[made[n].alias(n) for n in names])

    cache = FeatureCache(spark, workspace(spark, "cache"))
    for names in (["root"], ["root", "part"], ["part", "root"]):
        out = cache.get_or_extend("orders", names, ["o_orderkey"], build)
    return out.select("o_orderkey", "root", "part", F.lit("; ".join(built)).alias("built"))


@_query(
    "latest_rows",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'new' WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'now' ELSE o_orderpriority END AS o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS version FROM orders "
    "WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_orderkey % 6 > 0) UNION ALL SELECT -1 - o_orderkey, NULL, o_orderstatus, 0 FROM orders WHERE o_orderkey % 50 = 1",
)
def _latest(spark, d):
    """Delete and update by equal values, upsert by version (older rows lose), insert with a column missing."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.lit(1).alias("version"))
    out = tables.delete_where(orders, {"o_orderstatus": "O", "o_orderpriority": "5-LOW"})
    out = tables.update_where(out, {"o_orderstatus": "P", "o_orderpriority": "1-URGENT"}, {"o_orderpriority": "now"})
    newer = orders.where("o_orderkey % 6 = 0").withColumns({"o_orderpriority": F.lit("new"), "version": F.lit(2)})
    older = orders.where("o_orderkey % 6 = 0").withColumns({"o_orderpriority": F.lit("old"), "version": F.lit(0)})
    out = tables.upsert(tables.upsert(out, newer, ["o_orderkey"], "version"), older, ["o_orderkey"], "version")
    return tables.insert(out, orders.where("o_orderkey % 50 = 1").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus", F.lit(0).alias("version"), F.lit("x").alias("unknown")))


_HASH = "substr(md5(CONCAT('42', chr(1), CAST({} AS VARCHAR))), 1, 15)"


@_query("sample_exactly_portable", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_HASH.format('o_orderkey')}, o_orderkey LIMIT 200")
def _exactly(spark, d):
    """Rows that any engine with md5 chooses alike."""
    return sampling.exactly(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 200, ["o_orderkey"], hashed=sampling.portable_hash)


@_query("sample_share_portable", f"SELECT o_custkey, o_orderkey FROM orders WHERE CAST('0x' || {_HASH.format('o_custkey')} AS BIGINT) < (1::BIGINT << 57)")
def _share(spark, d):
    """An eighth of all customers with all their orders."""
    return sampling.bernoulli(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), 0.125, ["o_custkey"], hashed=sampling.portable_hash)


@_query("sample_train_size", f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {_HASH.format('o_orderkey')}, o_orderkey) <= floor(count(*) OVER () * 0.3)")
def _train(spark, d):
    return sampling.train_size(_t(spark, d, "orders").select("o_orderkey"), 0.3, ["o_orderkey"], hashed=sampling.portable_hash)


@_query(
    "stratified_holdout",
    f"WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_orderkey, r <= round(n * 0.2::DOUBLE) AS test FROM r",
)
def _holdout(spark, d):
    train, test = sampling.stratified_holdout(_t(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", 0.2, ["o_orderkey"], hashed=sampling.portable_hash)
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@_query(
    "bins_of_other_strategy",
    "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1.0]))) AS q FROM orders) SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE len(list_filter(q[2:4], lambda x: x < o_totalprice)) END AS BIGINT) AS o_totalprice_bin_4 FROM orders, "
    "(SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1.0]))) AS q FROM orders WHERE o_orderkey % 9 > 0)",
)
def _other_bins(spark, d):
    """A strategy of another name cuts at quantiles; gaps are in no bin."""
    df = _t(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END").alias("o_totalprice"))
    return _rounded(binning.binning_features(df, ["o_totalprice"], 4, "other", dummies=False).drop("o_totalprice"))


@_query(
    "ranks_of_equal_values",
    "SELECT o_orderkey, CAST(rank() OVER w AS DOUBLE) AS least, CAST(rank() OVER w + count(*) OVER (PARTITION BY o_custkey) - 1 AS DOUBLE) AS most, CAST(dense_rank() OVER w AS DOUBLE) AS tight, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS DOUBLE) AS nth FROM orders WINDOW w AS (ORDER BY o_custkey)",
)
def _tied(spark, d):
    out = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    for method, name in (("min", "least"), ("max", "most"), ("dense", "tight"), ("first", "nth")):
        out = ranking.ranking_features(out, ["o_custkey"], method, ["o_orderkey"]).withColumn(name, F.col("o_custkey_rank")).select("o_orderkey", "o_custkey", *[c for c in ("least", "most", "tight", "nth") if c in out.columns or c == name])
    return out.drop("o_custkey")


_FORMS = ["%Y-%m-%d 10:20:30", "%Y-%m-%d", "%d.%m.%Y", "%b %Y", "%Y", "%m/%Y", "someday", " "]
_KEPT = ["%Y-%m-%d 10:20:30", "%Y-%m-%d 00:00:00", "%Y-%m-%d 00:00:00", "%Y-%m-01 00:00:00", "%Y-01-01 00:00:00", "%Y-%m-01 00:00:00", None, None]
_SHOWN = ["%Y-%m-%d 10:20:30", "%Y-%m-%d", "%Y-%m-%d", "%Y-%m", "%Y", "%Y-%m", None, None]
_FINEST = ["second", "day", "day", "month", "year", "month", None, None]


def _pick(values: list[str | None], as_format: bool = True) -> str:
    one = lambda v: "NULL" if v is None else f"strftime(o_orderdate, '{v}')" if as_format else f"'{v}'"
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {one(v)}" for i, v in enumerate(values)) + " END"


@_query(
    "mixed_dates",
    f"WITH p AS (SELECT o_orderkey, {_pick(_KEPT)} AS day_parsed, {_pick(_FINEST, False)} AS day_precision, {_pick(_SHOWN)} AS day_text FROM orders) SELECT *, CASE WHEN o_orderkey % 8 = 7 THEN 'missing' WHEN o_orderkey % 8 = 6 THEN 'unparsable' WHEN day_parsed > '1997-06-30 00:00:00' THEN 'future' WHEN day_parsed < '1993-01-01 00:00:00' THEN 'too early' END AS day_problem FROM p",
)
def _mixed(spark, d):
    """Dates in six forms, each parsed to what it names, and what is wrong with the others."""
    form = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%b": "MMM"}
    at, day = F.col("o_orderdate"), None
    for i, f in enumerate(_FORMS):
        for k, v in form.items():
            f = f.replace(k, v)
        text = F.lit(f) if "%" not in _FORMS[i] else F.concat(F.date_format(at, f.removesuffix(" 10:20:30")), F.lit(" 10:20:30" if i == 0 else ""))
        day = F.when(F.col("o_orderkey") % 8 == i, text) if day is None else day.when(F.col("o_orderkey") % 8 == i, text)
    df = _t(spark, d, "orders").select("o_orderkey", day.alias("day"))
    parsed = df.withColumn("_p", dates.parse_date(F.col("day")))
    out = dates.date_columns(df, "day", "1997-06-30")
    problem = parsed.select("o_orderkey", dates.check_date(F.col("day"), F.col("_p"), "1997-06-30", "1993-01-01").alias("day_problem"))
    return out.drop("day", "day_problem").join(problem, "o_orderkey").withColumn("day_parsed", F.date_format("day_parsed", "yyyy-MM-dd HH:mm:ss"))


_SPOILT = "CASE event_id % 11 WHEN 3 THEN 'NaN'::DOUBLE WHEN 5 THEN 'Infinity'::DOUBLE WHEN 6 THEN -'Infinity'::DOUBLE WHEN 7 THEN NULL WHEN 8 THEN value * 1e15 ELSE value END"
_BELOW = "CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1e-12 WHEN 2 THEN NULL ELSE -4 END"


@_query(
    "clean_numbers",
    f"WITH s AS (SELECT event_id, {_SPOILT} AS x, CAST({_BELOW} AS DOUBLE) AS y FROM events), m AS (SELECT median(x) AS md FROM s WHERE NOT isnan(x) AND NOT isinf(x)) "
    "SELECT event_id, round(greatest(least(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN md ELSE x END, 1e15), -1e15), 4) AS cleaned, CASE WHEN x IS NULL OR y IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE round(x / CASE WHEN abs(y) < 1e-10 THEN 1e-10 ELSE y END / 1e15, 9) END AS ratio FROM s, m",
)
def _numbers(spark, d):
    """NaN, infinities, gaps and large values cleaned; quotients by nothing, next to nothing and gaps."""
    odd = {3: F.lit(float("nan")), 5: F.lit(float("inf")), 6: F.lit(float("-inf")), 7: F.lit(None).cast("double"), 8: F.col("value") * 1e15}
    x = F.col("value")
    for k, v in odd.items():
        x = F.when(F.col("event_id") % 11 == k, v).otherwise(x)
    y = F.when(F.col("event_id") % 5 == 0, 0.0).when(F.col("event_id") % 5 == 1, 1e-12).when(F.col("event_id") % 5 == 2, None).otherwise(-4.0)
    df = _t(spark, d, "events").select("event_id", x.alias("x"), y.alias("y"))
    median = profile(df, ["x"], (0.5,))["x"]["q"][0.5]
    return df.select("event_id", F.round(clean_numeric(F.col("x"), median), 4).alias("cleaned"), F.round(safe_divide(F.col("x"), F.col("y")) / 1e15, 9).alias("ratio"))


@_query(
    "fitted_features",
    "WITH tr AS (SELECT * FROM orders WHERE o_orderkey % 4 > 0 AND NOT (o_orderpriority = '5-LOW')), a AS (SELECT avg(o_custkey) AS mean, count(*) AS n, list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM tr), "
    "g AS (SELECT o_orderpriority AS v, count(*) AS k, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_custkey) AS y FROM tr GROUP BY 1) "
    "SELECT o_orderkey, round(coalesce(k / CAST(n AS DOUBLE), 0), 6) AS o_orderpriority_frequency, round(coalesce((y + mean) / (k + 1), mean), 6) AS o_orderpriority_target_encoded, round(m, 4) AS o_totalprice_mean_by_o_orderpriority, round(s, 4) AS o_totalprice_std_by_o_orderpriority, "
    "round(coalesce(o_totalprice - m, 0), 4) AS o_totalprice_dev_from_o_orderpriority_mean, round(coalesce(least(greatest((o_totalprice - lo) / (hi - lo), 0), 1), 0), 6) AS o_totalprice_norm_by_o_orderpriority, CAST(len(list_filter(q[2:5], lambda e: e < o_totalprice)) AS BIGINT) AS o_totalprice_qbin "
    "FROM orders LEFT JOIN g ON o_orderpriority = v, a WHERE o_orderkey % 4 = 0",
)
def _fitted(spark, d):
    """Encodings learned from three quarters of the orders, without one priority, and applied to the other quarter; columns as training has them, without the target."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    train, test = orders.where("o_orderkey % 4 > 0 AND o_orderpriority <> '5-LOW'"), orders.where("o_orderkey % 4 = 0")
    seen = fitted.fit(train, ["o_orderpriority"], ["o_totalprice"], target="o_custkey")
    out = pipeline.align(fitted.transform(train, seen), fitted.transform(test.drop("o_custkey").withColumn("only_here", F.lit(1)), seen), "o_custkey")[1]
    four = {c: F.round(c, 4) for c in out.columns if "_mean" in c or "_std_" in c}
    return _rounded(out.drop("o_orderpriority", "o_totalprice", *[c for c in out.columns if "_min_" in c or "_max_" in c]).withColumns(four))


@_query(
    "enlarged_rows",
    "SELECT c AS copy, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS customers, true AS near_mean, true AS near_spread FROM orders, (VALUES (0), (1), (2)) v(c) GROUP BY c",
)
def _enlarged(spark, d):
    """Three copies of each order; the noise's mean and deviation are within a hundredth of the price's own spread of what was asked."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_totalprice").alias("was"))
    out = sampling.enlarge(orders, 3, ["o_totalprice"], ["o_orderkey"], noise=0.05)
    own, off = F.stddev_samp("was"), F.col("o_totalprice") - F.col("was")
    asked = F.when(F.col("copy") == 0, 0.0).otherwise(0.05)
    return out.groupBy("copy").agg(F.count("*").alias("n_rows"), F.sum("o_custkey").alias("customers"), (F.abs(F.avg(off)) <= own * 0.01).alias("near_mean"), (F.abs(F.stddev_samp(off) / own - F.max(asked)) <= 0.01).alias("near_spread"))


_COST = "b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(sum(l_extendedprice), 2) AS cost FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def _all_columns_sql() -> str:
    w, out = "OVER (PARTITION BY o_orderstatus)", ["o_orderkey", "o_orderstatus", "o_totalprice", "quantity", "cost"]
    for x in ("quantity", "cost"):
        v = f"({x} / CASE WHEN (SELECT max({x}) FROM b) > 1000 THEN 1000.0 ELSE 1.0 END)"
        out += [f"round({e}, 3) AS {x}_{n}_by_o_orderstatus" for n, e in (("mean", f"avg({x}) {w}"), ("std", f"coalesce(stddev_samp({x}) {w}, 0)"), ("min", f"min({x}) {w}"), ("max", f"max({x}) {w}"))]
        out += [f"CAST(count({x}) {w} AS BIGINT) AS {x}_count_by_o_orderstatus", f"round({x} - avg({x}) {w}, 3) AS {x}_dev_from_o_orderstatus_mean", f"round(({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}), 6) AS {x}_norm_by_o_orderstatus"]
        out += [f"round({v} * {v}, 3) AS {x}_squared", f"round(ln(1 + {x}), 6) AS {x}_log", f"round(sqrt({x}), 6) AS {x}_sqrt", f"round(1 / {x}, 9) AS {x}_reciprocal"]
        edges = f"(SELECT list_sort(list_distinct(quantile_cont({x}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) FROM b)"
        bins = f"len(list_filter({edges}[2:5], lambda e: e < {x}))"
        out += [f"CAST({bins} AS BIGINT) AS {x}_qbin_5", *[f"CAST(CASE WHEN {bins} = {k} THEN 1 ELSE 0 END AS BIGINT) AS {x}_is_bin_{k}" for k in range(5)]]
    out.append("round(quantity * cost / greatest((SELECT greatest(max(cost), max(quantity)) FROM b) / 1000, 1), 3) AS quantity_x_cost")
    c = "o_orderstatus"
    out += [f"round(count(*) {w} / CAST(count(*) OVER () AS DOUBLE), 6) AS {c}_frequency", f"CAST(count(*) {w} AS BIGINT) AS {c}_count", f"(SELECT CAST(r AS BIGINT) FROM k WHERE v = {c}) AS {c}_frequency_rank", f"(SELECT CAST(lb AS BIGINT) FROM k WHERE v = {c}) AS {c}_label_encoded"]
    out += [f"round((sum(o_totalprice) {w} + avg(o_totalprice) OVER ()) / (count(*) {w} + 1), 3) AS {c}_target_encoded", f"round(var_samp(o_totalprice) {w} / 1e6, 3) AS {c}_target_variance", *[f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS BIGINT) AS {c}_is_{v.lower()}" for v in "FOP"]]
    return f"WITH {_COST}, k AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS r, row_number() OVER (ORDER BY o_orderstatus) - 1 AS lb FROM b GROUP BY 1) SELECT {', '.join(out)} FROM b"


@_query("feature_pipeline_all_columns", _all_columns_sql())
def _all_columns(spark, d):
    """All generic features of orders and the sums of their lines, large values scaled; no column is left out."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("Quantity"), F.round(F.sum("l_extendedprice"), 2).alias("Cost"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    out = pipeline.build(orders, ["o_orderstatus"], ["Quantity", "Cost"], target="o_totalprice", signal=False, unequal=False).data
    own = {c: 6 for c in out.columns if c.endswith(("_log", "_sqrt", "_frequency")) or "_norm_by_" in c} | {c: 9 for c in out.columns if c.endswith("_reciprocal")} | {c: 2 for c in ("o_totalprice", "cost", "quantity")}
    out = out.withColumn("o_orderstatus_target_variance", F.col("o_orderstatus_target_variance") / 1e6)
    return _rounded(out.withColumns({c: F.round(c, own.get(c, 3)) for c, t in out.dtypes if t == "double"}), 9)

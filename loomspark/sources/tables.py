"""Reading and writing tables, dataset discovery, and keyed stores kept as Parquet."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Which file of a dataset is which, by name; the first that fits.
SPLITS = [("train", r"train"), ("test", r"test"), ("submission", r"submission|sample"), ("validation", r"valid|val\b")]
#: Type names of other stores and Spark's types.
TYPES = {
    "integer": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(), "float": T.DoubleType(), "double": T.DoubleType(), "real": T.DoubleType(), "decimal": T.DecimalType(38, 18),
    "numeric": T.DecimalType(38, 18), "varchar": T.StringType(), "text": T.StringType(), "char": T.StringType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "blob": T.BinaryType(), "json": T.StringType(),
}


def spark_type(name: str) -> T.DataType:
    """Spark's type for another store's type name, with or without a size; text if unknown."""
    return TYPES.get(re.sub(r"\(.*", "", name).strip().lower(), T.StringType())


def read(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV (with header), JSON or ORC by the first path's ending; several files are one table; names in lower case."""
    kind = paths[0].rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        df = reader.csv(list(paths), header=True, inferSchema=schema is None, sep="\t" if kind == "tsv" else ",", escape='"')
    elif kind in ("json", "orc"):
        df = reader.format(kind).load(list(paths))
    else:
        df = reader.parquet(*paths)
    return df.toDF(*[c.lower() for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """A table dealt over all cores, if its files give fewer tasks than there are: few large row groups, before costly expressions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def to_parquet(spark: SparkSession, path: str, out: str) -> DataFrame:
    """A table converted to snappy Parquet, and read from there."""
    read(spark, path).write.mode("overwrite").option("compression", "snappy").parquet(out)
    return spark.read.parquet(out)


def split_files(names: list[str]) -> dict[str, str]:
    """The file of each split; train is needed."""
    out: dict[str, str] = {}
    for n in sorted(names):
        for split, rx in SPLITS:
            if re.search(rx, n.lower()) and split not in out:
                out[split] = n
                break
    if "train" not in out:
        raise ValueError("no training file")
    return out


def dataset_id(parts: list[str]) -> str:
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def as_json_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): each row as JSON; from_json_rows() restores it."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("data"))


def from_json_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(F.from_json("data", schema).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key, by this column; of equal ones the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def delete_where(df: DataFrame, equal: dict) -> DataFrame:
    """The rows that don't have all of these values."""
    test = F.lit(True)
    for k, v in equal.items():
        test = test & F.col(k).eqNullSafe(F.lit(v))
    return df.where(~test)


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; columns that new lacks are null."""
    return old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)


def update_where(df: DataFrame, equal: dict, values: dict) -> DataFrame:
    """The table with these values in the rows that have all of the equal ones."""
    test = F.lit(True)
    for k, v in equal.items():
        test = test & F.col(k).eqNullSafe(F.lit(v))
    return df.withColumns({k: F.when(test, F.lit(v).cast(dict(df.dtypes)[k])).otherwise(F.col(k)) for k, v in values.items()})


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV (with header), JSON lines or ORC."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    elif kind in ("parquet", "json", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")


def read_split(spark: SparkSession, files: dict[str, str], split: str) -> DataFrame:
    """A data set's table of one split, from the files that split_files() found."""
    if split not in files:
        raise ValueError(f"no such split: {split}")
    return read(spark, files[split])


def file_profile(spark: SparkSession, path: str) -> dict:
    """Rows, columns, types and bytes of a file or folder of files."""
    df, jvm = read(spark, path), spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return {"rows": df.count(), "columns": len(df.columns), "types": dict(df.dtypes), "bytes": size}


def migrate(df: DataFrame, path: str, include: list[str] | None = None, exclude: list[str] = (), types: dict[str, str] | None = None, dry_run: bool = False) -> dict:
    """Write chosen columns, with other stores' type names turned into Spark's; what was or would be done."""
    cols = [c for c in (include or df.columns) if c not in exclude]
    out = df.select(*[F.col(c).cast(spark_type(types[c])) if types and c in types else F.col(c) for c in cols])
    if not dry_run:
        export(out, path)
    return {"columns": cols, "types": dict(out.dtypes), "rows": out.count(), "written": not dry_run}


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_distinct, mode_frequency) of each column's values, each column counted by itself: a row is never copied for another column's sake."""
    parts = [df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).agg(F.lit(c).alias("column_name"), F.count("*").alias("n_distinct"), F.max("n").alias("mode_frequency")) for c in cols]
    return reduce(lambda a, b: a.union(b), parts)


def column_metadata(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, mean, std, min, max, null_ratio, unique_count, mode_frequency) of each column, numbers as numbers, others by their values only."""
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    none = F.lit(None).cast("double")
    one = df.agg(*[F.struct(*[(f(c) if c in numeric else none).cast("double").alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))], F.avg(F.col(c).isNull().cast("double")).alias("null_ratio")).alias(c) for c in cols])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("s")) for c in cols])).alias("r")).select("r.column_name", "r.s.*")
    return rows.join(value_counts(df, cols).withColumnRenamed("n_distinct", "unique_count"), "column_name")


def json_equals(c: Column, path: str, value) -> Column:
    """Whether a JSON text has this value at a path such as $.a.b; as text, as JSON has no types of its own."""
    return F.get_json_object(c, path) == F.lit(str(value).lower() if isinstance(value, bool) else str(value))


def same_id(c: Column, text: str) -> Column:
    """Equality of ids whatever their case and dashes."""
    return F.lower(F.replace(c, F.lit("-"))) == text.lower().replace("-", "")


#: Comparisons of filter dictionaries.
COMPARE = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c != v, "$like": lambda c, v: c.like(v), "$in": lambda c, v: c.isin(*v), "$ilike": lambda c, v: c.ilike(v), "$json": lambda c, v: reduce(lambda a, b: a & b, [json_equals(c, k, x) for k, x in v.items()]), "$id": same_id}


def filtered(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows that meet all conditions: value, list of values, None, or {operator: value}."""
    for name, want in conditions.items():
        c = F.col(f"`{name}`")
        for test in [COMPARE[op](c, v) for op, v in want.items()] if isinstance(want, dict) else [c.isNull() if want is None else c.isin(*want) if isinstance(want, list) else c == want]:
            df = df.where(test)
    return df


def column_stats(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null, n_distinct, min_text, max_text) of each column."""
    one = df.agg(*[F.struct(F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), F.min(c).cast("string").alias("min_text"), F.max(c).cast("string").alias("max_text")).alias(c) for c in df.columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in df.columns])).alias("r")).select("r.column_name", "r.s.*")
    return rows.join(value_counts(df, df.columns).drop("mode_frequency"), "column_name").select("column_name", "n_rows", "n_null", "n_distinct", "min_text", "max_text")


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list]:
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"missing_in_second": sorted(x.keys() - y.keys()), "missing_in_first": sorted(y.keys() - x.keys()), "types_differ": sorted(c for c in x.keys() & y.keys() if x[c] != y[c])}


def detect_target(df: DataFrame, rows: int = 100) -> str | None:
    """The target by name, else the column with the fewest values in the first rows."""
    for rx in (r"^target$", r"^label$", r"^class$", r"^y$", r"target|label|class|outcome"):
        for c in df.columns:
            if re.search(rx, c.lower()):
                return c
    few = df.limit(rows).agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    return min((c for c, t in df.dtypes if t == "string" or few[c] <= 20), key=lambda c: few[c], default=None)


def detect_id(df: DataFrame) -> str | None:
    """The first column named like an id whose values are all different; one scan's estimates tell which columns are worth an exact count."""
    names = [c for c in df.columns if re.search(r"id$|^id", c.lower())]
    if not names:
        return None
    row = df.agg(F.count("*").alias("_n"), *[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), 14)).alias(c) for c in names]).first()
    near = (c for c in names if row[c] >= 0.9 * row["_n"])
    return next((c for c in near if df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().count() == row["_n"]), None)

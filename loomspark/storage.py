"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors.

Results are lazy and may read these tables as long as they are used, so they stay until the folder is cleared, but for
those of rounds that a later round replaces.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and all run on one machine."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
    return _own_root


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; each call gives another one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A table that grows with the input, for joins: it is never broadcast. Ids and depths take a byte or two a row in files, so that Spark, which goes by the files' size, would send millions of rows through the driver."""
    return df.hint("shuffle_merge")


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)

"""Many CSV files as one table, though their columns, order and types drift; lines that don't fit their file's header are kept apart.

The first line of each file is found in one scan; files with equal headers are read together, as text; a second scan tells the narrowest type
that holds every value of a column over all files. Nothing is sampled, and no value is lost: what is no number in one file makes the column text in all.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize

REJECTED = "_rejected"
#: Types from narrow to wide, with a test of whether a text is one; text is what is left.
KINDS = {"bigint": r"^[+-]?[0-9]{1,18}$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$", "boolean": r"^(?i:true|false)$"}


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files of each first line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.groupBy("file").agg(F.min(F.struct("at", "n", "value"))["value"].alias("head"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():  # a row a file
        out.setdefault(r["head"], []).append(r["file"])
    return out


def _fits(c: Column, kind: str) -> Column:
    known = c.rlike(KINDS[kind])
    return known & c.try_cast(kind).isNotNull() if kind in ("date", "timestamp") else known


def widest(table: DataFrame, cols: list[str]) -> dict[str, str]:
    """The narrowest type of each text column that holds all its values, in one scan; text for a column without any."""
    tests = [F.struct(F.count(F.col(f"`{c}`")).alias("n"), *[F.count_if(_fits(F.col(f"`{c}`"), k)).alias(k) for k in KINDS]).alias(f"c{i}") for i, c in enumerate(cols)]
    row = table.agg(*tests).first() if cols else []
    return {c: next((k for k in KINDS if s["n"] and s[k] == s["n"]), "string") for c, s in zip(cols, row, strict=True)}


def read(spark: SparkSession, paths: list[str], sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(table, rejected): all files' rows, by column name in lower case, with columns that a file lacks as null; and (file, line) of what didn't fit."""
    parts, bad = None, None
    for head, files in headers(spark, paths).items():
        names = [n.strip().lower() for n in next(csv.reader([head.removeprefix("﻿")], delimiter=sep))]
        if len(set(names)) < len(names) or REJECTED in names:
            raise ValueError(f"column names occur twice: {names}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECTED]])
        own = spark.read.csv(files, schema=schema, header=True, enforceSchema=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED, escape='"').withColumn("_file", F.col("_metadata.file_path"))
        parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
    if parts is None:
        raise ValueError("no files")
    parts = materialize(parts, "lines")  # parsed once
    bad = parts.where(F.col(REJECTED).isNotNull()).select(F.col("_file").alias("file"), F.col(REJECTED).alias("line"))
    good = parts.where(F.col(REJECTED).isNull()).drop(REJECTED, "_file")
    kinds = widest(good, good.columns)
    return good.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in good.columns]), bad

"""Keyed tables on Parquet that are changed in place: rows are dealt into buckets by their keys, a change rewrites only the buckets
that it touches, and a version is a small file that names each bucket's folders. A version counts once its file has its name, by one rename;
a write that dies before leaves the last version as it was, and of two writers from one version the second fails.

Changed keys meet the old rows of their buckets by a shuffle join; nothing but bucket numbers and folder names passes through the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another write came first."""


class Versions:
    """The versions of what lies in a folder that driver and executors share, each a small file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        self._fs = self._versions.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._versions):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(self._versions) if f.getPath().getName()[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds: its schema, the folders of each bucket, and the writer's note."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"no such version of {self.path}: {version}")
        file = f"{self.path}/versions/{known[-1] if version is None else version:020d}.json"
        return json.loads(self.spark.read.text(file, wholetext=True).first()[0])

    def history(self) -> list[dict]:
        return [{"version": v} | self.manifest(v)["note"] for v in self.versions()]

    def _commit(self, after: int, manifest: dict) -> int:
        """Give version after + 1 its name; whoever comes second fails."""
        self._fs.mkdirs(self._versions)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        done, draft = path(self._versions, f"{after + 1:020d}.json"), path(self._versions, f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(done) or not self._fs.rename(draft, done):
            self._fs.delete(draft, False)
            raise Conflict(f"version {after + 1} of {self.path} is there already")
        return after + 1


class StoredTable(Versions):
    """A table whose versions name the folders of its rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        super().__init__(spark, path)
        self.keys, self.buckets = list(keys), buckets

    def _numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, numbered: DataFrame) -> dict[str, str]:
        """A folder for each bucket that has rows."""
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        numbered.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(where) if f.isDirectory()] if self._fs.exists(where) else []
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names}

    def _rows(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        folders = [f for b, fs in manifest["buckets"].items() if buckets is None or b in buckets for f in fs]
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def create(self, rows: DataFrame, note: dict | None = None) -> int:
        """The first version; keys are taken to be unique."""
        if self.versions():
            raise Conflict(f"{self.path} is there already")
        new = self._write(self._numbered(rows))
        return self._commit(0, {"schema": rows.schema.jsonValue(), "buckets": {b: [f] for b, f in new.items()}, "note": {"change": "create"} | (note or {})})

    def _replace(self, version: int, manifest: dict, touched: set[str], rows: DataFrame, note: dict) -> int:
        new = self._write(self._numbered(rows))
        buckets = {b: fs for b, fs in manifest["buckets"].items() if b not in touched} | {b: [f] for b, f in new.items()}
        return self._commit(version, manifest | {"buckets": buckets, "note": note})

    def insert(self, rows: DataFrame, note: dict | None = None) -> int:
        """Add rows; keys are not compared, and no bucket is rewritten. Columns that are missing are null."""
        version, manifest = self.versions()[-1], self.manifest()
        new = self._write(self._numbered(self._fitted(rows, manifest)))
        buckets = {b: list(fs) for b, fs in manifest["buckets"].items()}
        for b, f in new.items():
            buckets.setdefault(b, []).append(f)
        return self._commit(version, manifest | {"buckets": buckets, "note": {"change": "insert"} | (note or {})})

    def _fitted(self, rows: DataFrame, manifest: dict) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    def merge(self, rows: DataFrame, order: str | None = None, note: dict | None = None) -> int:
        """Put rows in the place of those with equal keys, or add them. Of several with one key the last by `order` counts, then that of the least hash."""
        version, manifest = self.versions()[-1], self.manifest()
        fitted = self._numbered(self._fitted(rows, manifest))
        last = Window.partitionBy(*self.keys).orderBy(*([F.desc_nulls_last(order)] if order else []), F.xxhash64(*fitted.columns))
        new = fitted.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        touched = {str(r[0]) for r in new.select(BUCKET).distinct().collect()}  # a row a bucket
        gone = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        kept = self._rows(manifest, touched).join(gone, same, "left_anti")
        return self._replace(version, manifest, touched, kept.unionByName(new.drop(BUCKET)), {"change": "merge"} | (note or {}))

    def _where(self, manifest: dict, test: Column) -> set[str]:
        """Buckets with rows that meet a test."""
        return {str(r[0]) for r in self._numbered(self._rows(manifest)).where(test).select(BUCKET).distinct().collect()}

    def update(self, test: Column, values: dict[str, Column], note: dict | None = None) -> int:
        """New values, not of keys, in the rows that meet a test."""
        if set(values) & set(self.keys):
            raise ValueError("keys stay as they are: delete and insert")
        version, manifest = self.versions()[-1], self.manifest()
        touched = self._where(manifest, test)
        rows = self._rows(manifest, touched)
        kinds, hit = dict(rows.dtypes), F.coalesce(test, F.lit(False))
        changed = rows.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})
        return self._replace(version, manifest, touched, changed, {"change": "update"} | (note or {}))

    def delete(self, test: Column, note: dict | None = None) -> int:
        """Without the rows that meet a test; a null test keeps a row."""
        version, manifest = self.versions()[-1], self.manifest()
        touched = self._where(manifest, test)
        rows = self._rows(manifest, touched).where(~F.coalesce(test, F.lit(False)))
        return self._replace(version, manifest, touched, rows, {"change": "delete"} | (note or {}))

    def restore(self, version: int) -> int:
        """A new version that holds what an earlier one did."""
        return self._commit(self.versions()[-1], self.manifest(version) | {"note": {"change": "restore", "of": version}})

    def vacuum(self, keep: int = 10) -> int:
        """Forget all but the last versions, and remove the folders that none of these names, those of writes that died among them; returns how many went. Not to be run beside a write."""
        known = self.versions()
        used = {f.rpartition("/")[0].rpartition("/")[2] for v in known[-keep:] for fs in self.manifest(v)["buckets"].values() for f in fs}
        path, gone = self.spark._jvm.org.apache.hadoop.fs.Path, 0
        for v in known[:-keep]:
            self._fs.delete(path(self._versions, f"{v:020d}.json"), False)
        for f in self._fs.listStatus(path(f"{self.path}/rows")):
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)
                gone += 1
        return gone


def migrate(source: DataFrame, table: StoredTable, name: str, batches: int = 8) -> int:
    """Copy a table in batches of keys, each one version that says which it is; started again, it goes on after the last. Returns how many it copied now."""
    part, copied = F.pmod(F.xxhash64(F.lit(name), *table.keys), F.lit(batches)), 0
    done = {h.get("batch") for h in table.history() if h.get("migration") == name}
    for b in range(batches):
        if b in done:
            continue
        rows, note = source.where(part == b), {"migration": name, "batch": b}
        table.insert(rows, note) if table.versions() else table.create(rows, note)
        copied += 1
    return copied

"""Features kept as Parquet by data set and feature set: built if missing, checked when read, columns of other sets taken over."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .stored import Conflict, Versions


def feature_set_id(features: list[str]) -> str:
    """The same for the same names, in whatever order."""
    return hashlib.md5("|".join(sorted(set(features))).encode()).hexdigest()


class FeatureCache:
    """Tables below a root that driver and executors share.

    A table is written to a folder of its own and counts once a version that names it is there, by one rename: a write that dies leaves
    the table before, and readers of that keep their files. Of two writers of one set, the first is kept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entry(self, dataset: str, features: list[str]) -> Versions:
        return Versions(self.spark, f"{self.root}/{dataset}/{feature_set_id(features)}")

    def get(self, dataset: str, features: list[str], check_rows: bool = False) -> DataFrame | None:
        """The kept table, or None if there is none or it is not what was written."""
        entry = self._entry(dataset, features)
        if not entry.versions():
            return None
        note = entry.manifest()
        df = self.spark.read.parquet(note["folder"])
        if df.columns != note["columns"] or check_rows and df.count() != note["rows"]:
            return None
        return df

    def put(self, dataset: str, features: list[str], df: DataFrame) -> DataFrame:
        entry = self._entry(dataset, features)
        known = entry.versions()
        folder = f"{entry.path}/rows/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        kept = self.spark.read.parquet(folder)
        try:
            entry._commit(known[-1] if known else 0, {"folder": folder, "rows": kept.count(), "columns": kept.columns, "note": {"features": sorted(set(features))}})
        except Conflict:  # another writer's table of the same set is there
            return self.get(dataset, features)
        return kept

    def sets(self, dataset: str) -> list[list[str]]:
        """The feature sets that are kept of a data set, larger ones first."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{dataset}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        entries = [Versions(self.spark, f"{self.root}/{dataset}/{f.getPath().getName()}") for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((e.manifest()["note"]["features"] for e in entries if e.versions()), key=lambda fs: (-len(fs), fs))

    def get_or_build(self, dataset: str, features: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(dataset, features)
        return found if found is not None else self.put(dataset, features, build())

    def get_or_extend(self, dataset: str, features: list[str], keys: list[str], build: Callable[[list[str]], DataFrame]) -> DataFrame:
        """(keys, features) where only features that no kept set has are built: build(missing) gives keys and missing; keys must be unique and not null."""
        found = self.get(dataset, features)
        if found is not None:
            return found
        missing, parts = sorted(set(features)), []
        for have in self.sets(dataset):
            df = self.get(dataset, have)
            take = [f for f in missing if f in have and df is not None and f in df.columns]
            if take and set(keys) <= set(df.columns):
                parts.append(df.select(*keys, *take))
                missing = [f for f in missing if f not in take]
        if missing or not parts:
            parts.append(build(missing).select(*keys, *missing))
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, keys, "full")
        return self.put(dataset, features, out.select(*keys, *dict.fromkeys(features)))

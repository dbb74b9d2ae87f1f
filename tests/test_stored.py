"""Stored tables, drifting files, rollups, trees and text search on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.plans import rollups, text_search, trees
from loomspark.sources import drifting
from loomspark.sources.stored import Conflict, StoredTable, migrate

SCHEMA = "k long, s string, x double"


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


@pytest.fixture()
def table(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t", ["k"], buckets=8)
    t.create(spark.createDataFrame([(i, "a", i / 2) for i in range(40)] + [(None, "none", 0.0)], SCHEMA))
    return t


def test_merges_rewrite_touched_buckets_only(spark, table):
    before = table.manifest()["buckets"]
    table.merge(spark.createDataFrame([(3, "b", None), (100, "new", 1.0), (None, "some", 2.0), (3, "c", 5.0)], SCHEMA), order="x", note={"by": "test"})
    want = {i: ("a", i / 2) for i in range(40)} | {3: ("c", 5.0), 100: ("new", 1.0), None: ("some", 2.0)}
    assert {r[0]: r[1:] for r in rows(table)} == want
    after = table.manifest()["buckets"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 3
    assert len(rows(table, 1)) == 41 and table.history()[-1]["by"] == "test"


def test_a_write_that_dies_leaves_the_last_version(spark, table, monkeypatch):
    def die(*_):
        raise OSError("lost")

    monkeypatch.setattr(StoredTable, "_commit", die)
    with pytest.raises(OSError):
        table.delete(F.col("k") < 20)
    monkeypatch.undo()
    assert len(rows(table)) == 41 and table.versions() == [1]
    table.delete(F.col("k") < 20)
    assert len(rows(table)) == 21  # a null key meets no test
    assert table.vacuum(keep=1) >= 1
    assert len(rows(table)) == 21 and table.versions() == [2]


def test_the_second_of_two_writers_fails(spark, table, tmp_path):
    other = StoredTable(spark, table.path, ["k"], 8)
    old = other.manifest()
    table.update(F.col("k") == 1, {"s": F.lit("mine")})
    with pytest.raises(Conflict):
        other._commit(1, old)
    assert [r for r in rows(table) if r[0] == 1] == [(1, "mine", 0.5)]
    with pytest.raises(ValueError):
        table.update(F.lit(True), {"k": F.lit(0)})


def test_restores_inserts_and_emptied_tables(spark, table):
    table.insert(spark.createDataFrame([(7, "twice")], "k long, s string"))
    assert len(rows(table)) == 42
    table.delete(F.lit(True))
    assert rows(table) == [] and table.read().columns == ["k", "s", "x"]
    table.restore(1)
    assert len(rows(table)) == 41
    with pytest.raises(LookupError):
        table.read(99)


def test_a_migration_goes_on_after_its_last_batch(spark, tmp_path, monkeypatch):
    source = spark.range(500).select(F.col("id").alias("k"), F.lit("s").alias("s"))
    t = StoredTable(spark, f"file://{tmp_path}/m", ["k"], 4)
    whole, calls = StoredTable.insert, []

    def insert(self, *a):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return whole(self, *a)

    monkeypatch.setattr(StoredTable, "insert", insert)
    with pytest.raises(OSError):
        migrate(source, t, "first", 6)
    assert 0 < t.read().count() < 500
    assert migrate(source, t, "first", 6) == 3 and migrate(source, t, "first", 6) == 0
    assert sorted(r.k for r in t.read().collect()) == list(range(500))


def test_files_of_drifting_columns(spark, tmp_path):
    files = {"a.csv": "id,x,day\n1,5,2024-01-02\n2,,2024-01-03\n", "b.csv": "x,id,Note\n2.5,3,\"a, \"\"b\"\"\"\n-1e3,4,\n", "c.csv": "id,x,day\n5,many,2024-02-30\n6,7\n7,8,2024-01-05,extra\n", "d.csv": "id,x,day\n"}
    for n, text in files.items():
        (tmp_path / n).write_text(text)
    table, bad = drifting.read(spark, [f"file://{tmp_path}/{n}" for n in files])
    assert dict(table.dtypes) == {"id": "bigint", "x": "string", "day": "string", "note": "string"}
    got = {r.id: (r.x, r.day, r.note) for r in table.collect()}
    assert got == {1: ("5", "2024-01-02", None), 2: (None, "2024-01-03", None), 3: ("2.5", None, 'a, "b"'), 4: ("-1e3", None, None), 5: ("many", "2024-02-30", None)}
    assert sorted(r.line for r in bad.collect()) == ["6,7", "7,8,2024-01-05,extra"]
    table, bad = drifting.read(spark, [f"file://{tmp_path}/{n}" for n in ("a.csv", "b.csv")])
    assert dict(table.dtypes) == {"id": "bigint", "x": "double", "day": "date", "note": "string"} and bad.count() == 0
    assert sorted(r.x for r in table.where("x is not null").collect()) == [-1000.0, 2.5, 5.0]
    table, _ = drifting.read(spark, [f"file://{tmp_path}/a.csv"])
    assert dict(table.dtypes)["x"] == "bigint"


def test_rollups_are_merged_and_replaced(spark, tmp_path):
    df = spark.range(20_000).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 20)").alias("t"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("x"), (F.col("id") % 500).alias("u"))
    days, path = rollups.rollup(df, "t", ["g"], "x", "u"), f"file://{tmp_path}/r"
    rollups.store(days.where("period < '2024-01-03'"), path, ["g"])
    rollups.store(days.where("period >= '2024-01-02'"), path, ["g"])  # a day twice
    got = rollups.estimates(rollups.merged(spark.read.parquet(path), ["g"]), (0.1, 0.5)).collect()
    assert sum(r.n for r in got) == 20_000
    for r in got:
        xs = sorted(x.x for x in df.where(F.col("g") == r.g).select("x").collect())
        for p, q in ((r.p10, 0.1), (r.p50, 0.5)):
            assert abs(sum(x <= p for x in xs) / len(xs) - q) < 0.02
        assert (r.least, r.most) == (xs[0], xs[-1]) and abs(r.n_distinct / 500 - 1) < 0.05
    assert rollups.merged(spark.read.parquet(path), ["g"], "2024-01-02", "2024-01-03").agg(F.sum("n")).first()[0] == 24 * 60 // 20
    assert rollups.estimates(rollups.merged(rollups.rollup(df.select("t", "g", F.lit(None).cast("double").alias("x")), "t", ["g"], "x"), ["g"])).first().p50 is None


def test_intervals_and_paths_of_deep_wide_and_broken_trees(spark):
    rng = random.Random(4)
    up = {0: None, 500: None, 900: 900}
    up |= {i: i - 1 for i in range(1, 70)} | {i: 500 for i in range(501, 700)} | {i: rng.choice([*range(70), *range(500, i)]) for i in range(700, 800)}
    broken = {1000: 1001, 1001: 1000, 1002: 1001, 1003: 4444}
    df = spark.createDataFrame([(n, p, n % 13) for n, p in (up | broken).items()], "node_id long, parent_id long, w long")
    kids = {}
    for n, p in up.items():
        kids.setdefault(None if p == n else p, []).append(n)
    want, place, way = {}, [0], {}

    def walk(n, above):
        at, way[n] = place[0], [*above, n]
        place[0] += 1
        below = [walk(k, way[n]) for k in sorted(kids.get(n, []))]
        size, total = 1 + sum(b[0] for b in below), n % 13 + sum(b[1] for b in below)
        want[n] = (len(above), at, size, total, max([n % 13, *(b[2] for b in below)]))
        return size, total, want[n][4]

    for root in sorted(kids[None]):
        walk(root, [])
    got = {r.node_id: (r.depth, r.place, r.size, r.t, r.m) for r in trees.intervals(df, {"t": ("sum", F.col("w")), "m": ("max", F.col("w"))}).collect()}
    assert got == want
    targets = [69, 799, 0, 900, 1002, 12345]
    found = {}
    for r in trees.paths(df, spark.createDataFrame([(t,) for t in targets], "target long")).collect():
        found.setdefault(r.target, {})[r.step] = r.node_id
    assert found == {t: dict(enumerate(way[t])) for t in targets if t in way}


def test_text_search_of_short_and_missing_texts(spark):
    df = spark.createDataFrame([(1, "Titanic", "/data/train.csv", None), (2, "titan", None, "about Titanic ships"), (3, "", "", ""), (4, None, "/x/tita", None), (5, "a", "b", "c")], "id long, name string, path string, about string")
    index = text_search.build(df, "id", {"name": ["name"], "path": ["path"], "description": ["about"]})
    asked = spark.createDataFrame([("TITANIC",), ("a",), ("ti",), ("",), (None,), ("zzz",), ("ship",)], "query string")
    got = {(r.query, r.key): (r.score, r.reasons) for r in text_search.search(index, asked).collect()}
    assert got == {
        ("titanic", 1): (100, "exact name"), ("titanic", 2): (45, "description, similar name"), ("a", 1): (80, "name, path"), ("a", 2): (70, "description, name"), ("a", 4): (30, "path"), ("a", 5): (100, "exact name"),
        ("ti", 1): (50, "name"), ("ti", 2): (70, "description, name"), ("ti", 4): (30, "path"), ("ship", 2): (20, "description"),
    }
    with pytest.raises(ValueError, match="unknown roles"):
        text_search.build(df, "id", {"nme": ["name"]})


@pytest.mark.parametrize("most", [0, 100_000])
def test_texts_of_many_keys_are_indexed_and_tested_once(spark, monkeypatch, most):
    monkeypatch.setattr(text_search, "MAX_BROADCAST_ROWS", most)
    names, paths = ["red ring", "old bolt", "ring"], ["a/1", "b/2"]
    rows = [(i, names[i % 3], paths[i % 2], f"no {i}" if i % 7 == 0 else None) for i in range(600)]
    index = text_search.build(spark.createDataFrame(rows, "id int, name string, path string, about string"), "id", {"name": ["name"], "path": ["path"], "description": ["about"]})
    assert index.texts.count() == 3 + 2 + 86 and index.grams.where("role <> 'description'").count() < 100
    want = {}
    for q in ("ring", "b", "no 7", "r", "gnir", "/"):
        for i, name, path, about in rows:
            near = len(set(q) & set(name)) >= 0.6 * len(set(q)) - 1e-9
            kinds = [k for k, is_ in (("exact name", name == q), ("name", q in name and name != q), ("similar name", near and q not in name), ("path", q in path), ("description", q in (about or ""))) if is_]
            if kinds:
                want[q, i] = (sum(text_search.WEIGHTS[k] for k in kinds), ", ".join(sorted(kinds)))
    asked = spark.createDataFrame([(q,) for q in ("RING", "b", "no 7", "r", "gnir", "/")], "query string")
    assert {(r.query, r.key): (r.score, r.reasons) for r in text_search.search(index, asked).collect()} == want

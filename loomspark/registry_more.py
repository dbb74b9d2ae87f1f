"""Queries of trees, searches, stored tables and rollups by name, with SQL of another form beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import analytics, rollups, store, text_search, trees
from .sources.stored import StoredTable
from .storage import workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


_TREE = (
    f"WITH RECURSIVE history AS ({analytics.SOURCES['history']}), t AS (SELECT node_id, parent_id, 0 AS depth, [node_id] AS path FROM history WHERE parent_id IS NULL UNION ALL SELECT h.node_id, h.parent_id, t.depth + 1, list_append(t.path, h.node_id) FROM history h JOIN t ON h.parent_id = t.node_id), "
    "o AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS place FROM t)"
)


@_query(
    "store_tree_intervals",
    _TREE + ", b AS (SELECT a.node_id, count(*) AS size, sum(h.visits) AS visits, max(h.score) AS best FROM (SELECT node_id AS below, unnest(path) AS node_id FROM t) a JOIN history h ON h.node_id = a.below GROUP BY a.node_id) "
    "SELECT node_id, parent_id, CAST(depth AS BIGINT) AS depth, CAST(place AS BIGINT) AS place, CAST(size AS BIGINT) AS size, CAST(visits AS BIGINT) AS visits, round(best, 6) AS best FROM o JOIN b USING (node_id)",
)
def _intervals(spark, d):
    out = trees.intervals(store.from_sales(spark, d).history, {"visits": ("sum", F.col("visits")), "best": ("max", F.col("score"))})
    return out.withColumns({"depth": F.col("depth").cast("long"), "best": F.round("best", 6)})


@_query(
    "store_tree_paths",
    _TREE + ", g AS (SELECT session_id, arg_max(node_id, score * 1e9 - node_id / 1e9) AS target FROM history GROUP BY session_id), u AS (SELECT DISTINCT target, path FROM g JOIN t ON node_id = target) SELECT target, CAST(unnest(range(len(path))) AS BIGINT) AS step, unnest(path) AS node_id FROM u",
)
def _paths(spark, d):
    history = store.from_sales(spark, d).history
    best = history.groupBy("session_id").agg(F.max_by("node_id", F.struct("score", -F.col("node_id"))).alias("target"))
    return trees.paths(history, best).withColumn("step", F.col("step").cast("long"))


@_query(
    "store_tree_drawing",
    _TREE + ", s AS (SELECT *, node_id = max(node_id) OVER (PARTITION BY parent_id) AS last FROM o), f AS (SELECT * FROM s WHERE place < 50), b AS (SELECT f.node_id, string_agg(CASE WHEN a.last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) AS bars FROM f JOIN s a ON list_contains(f.path[1:f.depth], a.node_id) GROUP BY f.node_id) "
    "SELECT CAST(place + 1 AS BIGINT) AS line, coalesce(bars, '') || CASE WHEN last THEN '└── ' ELSE '├── ' END || operation || ' (ID:' || node_id || ') [score:' || printf('%.5f', score) || ', visits:' || visits || ']' AS text FROM f JOIN history USING (node_id) LEFT JOIN b USING (node_id)",
)
def _drawing(spark, d):
    return trees.drawing(store.from_sales(spark, d).history)


_SETS = "SELECT 'set-' || CAST(p_partkey AS VARCHAR(9)) AS id, p_name AS name, p_brand AS path, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS description, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' cup' END AS competition FROM part"
_ASKED = "SELECT DISTINCT lower(p_brand) AS query FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT unnest(['set-12', 'ing', 'd#1', 'qzx', 'e', 'cup', '1'])"


@_query(
    "dataset_search",
    f"WITH d AS ({_SETS}), q AS ({_ASKED}), l AS (SELECT query, list_distinct(string_split(query, '')) AS ls FROM q), n AS (SELECT DISTINCT name, list_distinct(string_split(lower(name), '')) AS ns FROM d), m AS (SELECT query, name, len(list_intersect(ls, ns)) >= 0.6 * len(ls) AS near FROM l, n), "
    "k AS (SELECT query, id AS key, CASE WHEN lower(name) = query THEN 'exact name' WHEN contains(lower(name), query) THEN 'name' WHEN near THEN 'similar name' END AS a, CASE WHEN contains(lower(id), query) THEN 'id' END AS b, CASE WHEN contains(lower(path), query) THEN 'path' END AS c, CASE WHEN contains(lower(description), query) THEN 'description' END AS e, CASE WHEN contains(lower(competition), query) THEN 'competition' END AS f FROM d JOIN m USING (name)) "
    "SELECT query, key, CAST(CASE a WHEN 'exact name' THEN 100 WHEN 'name' THEN 50 WHEN 'similar name' THEN 25 ELSE 0 END + CASE WHEN b IS NULL THEN 0 ELSE 75 END + CASE WHEN c IS NULL THEN 0 ELSE 30 END + CASE WHEN e IS NULL THEN 0 ELSE 20 END + CASE WHEN f IS NULL THEN 0 ELSE 40 END AS BIGINT) AS score, "
    "array_to_string(list_sort(list_filter([a, b, c, e, f], lambda x: x IS NOT NULL)), ', ') AS reasons FROM k WHERE coalesce(a, b, c, e, f) IS NOT NULL",
)
def _search(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("part")
    asked = _ASKED.replace("SELECT unnest(['set-12', 'ing', 'd#1', 'qzx', 'e', 'cup', '1'])", "SELECT explode(array('set-12', 'ing', 'd#1', 'qzx', 'e', 'cup', '1'))")
    index = text_search.build(spark.sql(_SETS), "id", {"name": ["name"], "id": ["id"], "path": ["path"], "description": ["description"], "competition": ["competition"]})
    return text_search.search(index, spark.sql(asked))


@_query(
    "operation_rollups",
    "SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, true AS p50_within, true AS p95_within, true AS distinct_within FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY event_type",
)
def _rollups(spark, d):
    """Merged daily sketches of whole days, and whether ranks are within 2 % and distinct users within 5 % of the exact ones."""
    events = spark.read.parquet(f"{d}/events.parquet")
    days = rollups.rollup(events, "ts", ["event_type"], "value", "user_id")
    path = workspace(spark, "rollups")
    rollups.store(days, path, ["event_type"])
    stored = spark.read.parquet(path)
    last = stored.agg(F.date_format(F.max("period"), "yyyy-MM-dd").alias("d")).first()["d"]
    got = rollups.estimates(rollups.merged(stored, ["event_type"], end=last))
    rows = events.where(F.col("ts") < F.lit(last).cast("timestamp")).join(F.broadcast(got), "event_type")  # a row an operation
    rank = lambda p: F.abs(F.avg((F.col("value") <= F.col(p)).cast("double")) - float(p[1:]) / 100) <= 0.02
    checks = rows.groupBy("event_type").agg(rank("p50").alias("p50_within"), rank("p95").alias("p95_within"), (F.abs(F.first("n_distinct") / F.count_distinct("user_id") - 1) <= 0.05).alias("distinct_within"))
    return got.join(checks, "event_type").select("event_type", "n", F.round("total", 4).alias("total"), "least", "most", "p50_within", "p95_within", "distinct_within")


@_query(
    "stored_table_changes",
    "WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 11 = 5) "
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'L' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM a WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 100000)",
)
def _stored(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = StoredTable(spark, workspace(spark, "stored"), ["o_orderkey"], buckets=16)
    table.create(orders)
    changed = orders.where("o_orderkey % 7 = 3").select("o_orderkey", F.lit("Z").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    added = orders.where("o_orderkey % 11 = 5").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    table.merge(changed.unionByName(added))
    table.delete((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000))
    table.update((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), {"o_orderstatus": F.lit("L")})
    return table.read().withColumn("o_totalprice", F.round("o_totalprice", 2))

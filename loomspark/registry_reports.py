"""Queries of the store's reports by name, with SQL of another form beside each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .plans import reports, store
from .registry_store import QUERIES as _ALL
from .registry_store import SQL as _ALL_SQL
from .registry_store import _int, _num, _query

_before = set(_ALL)
_NOW = "1996-03-20"

_query(
    "feature_details",
    f"WITH a AS (SELECT feature_no, count(*) AS uses, count(DISTINCT session_id) AS n, avg(delta) AS a, max(delta) AS hi, min(delta) AS lo, count(*) FILTER (delta > 0) AS pos FROM impact GROUP BY feature_no), l AS (SELECT *, row_number() OVER (PARTITION BY feature_no ORDER BY weight DESC, session_id DESC, delta DESC) AS place FROM impact QUALIFY place <= 10) "
    f"SELECT feature_no, feature_name, category, data_type, {_int('cost', 'cost')}, {_int('coalesce(uses, 0)', 'uses')}, {_num('a', 'avg_impact')}, {_num('hi', 'max_impact')}, {_num('lo', 'min_impact')}, {_int('coalesce(pos, 0)', 'positive')}, {_int('coalesce(n, 0)', 'n_sessions')}, {_num('coalesce(pos / CAST(uses AS DOUBLE), 0)', 'success_rate')}, {_int('place', 'place')}, session_id, session_name, dataset_name, {_num('delta', 'delta')} "
    "FROM catalog LEFT JOIN a USING (feature_no) LEFT JOIN l USING (feature_no) LEFT JOIN (SELECT session_id, session_name, dataset_name FROM sessions) USING (session_id)",
)(reports.feature_details)
_query(
    "catalog_totals",
    f"WITH c AS (SELECT *, unnest([1, 2, 3, 4]) AS i FROM catalog), g AS (SELECT ['total', 'total', 'category', 'data_type'][i] AS section, CASE i WHEN 1 THEN 'all' WHEN 2 THEN 'active' WHEN 3 THEN category ELSE data_type END AS name, cost FROM c WHERE is_active OR i = 1) SELECT section, name, {_int('count(*)', 'n')}, {_num('avg(cost)', 'avg_cost')} FROM g GROUP BY section, name",
)(reports.catalog_totals)

_SETS = (
    "k AS (SELECT dataset_name, count(*) AS n_sessions, count(*) FILTER (status = 'completed') AS n_completed, coalesce(avg(best_score) FILTER (status = 'completed' AND best_score <> 0), 0) AS avg_score, coalesce(max(best_score) FILTER (status = 'completed' AND best_score <> 0), 0) AS best_score, avg(total_iterations) FILTER (status = 'completed') AS avg_iterations, sum(total_iterations) FILTER (status = 'completed') AS iterations, max(start_time) AS last_used, array_to_string(list(session_id ORDER BY start_time DESC, session_id)[1:5], ',') AS recent_sessions FROM sessions GROUP BY dataset_name), "
    "z AS (SELECT dataset_name, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT dataset_name, status, count(*) AS n FROM sessions GROUP BY ALL) GROUP BY dataset_name), "
    "f AS (SELECT s.dataset_name, i.feature_no, count(*) AS n, avg(delta) AS a FROM impact i JOIN sessions s USING (session_id) GROUP BY ALL), v AS (SELECT dataset_name, count(*) AS n_features, sum(n) AS evaluations, sum(a * n) / sum(n) AS avg_impact FROM f GROUP BY dataset_name), "
    "b AS (SELECT dataset_name, array_to_string(list(feature_name ORDER BY round(a, 9) DESC, feature_name)[1:5], ',') AS top_features FROM f JOIN catalog USING (feature_no) GROUP BY dataset_name)"
)
_query(
    "dataset_details",
    f"WITH {_SETS} SELECT dataset_name, {_int('n_sessions', 'n_sessions')}, {_int('n_completed', 'n_completed')}, {_num('100.0 * n_completed / n_sessions', 'success_rate')}, {_num('avg_score', 'avg_score')}, {_num('best_score', 'best_score')}, {_num('avg_iterations', 'avg_iterations')}, {_int('iterations', 'iterations')}, last_used, statuses, recent_sessions, {_int('n_features', 'n_features')}, {_int('evaluations', 'evaluations')}, {_num('avg_impact', 'avg_impact')}, top_features, last_used > TIMESTAMP '{_NOW}' - INTERVAL 30 DAY AS active FROM k LEFT JOIN z USING (dataset_name) LEFT JOIN v USING (dataset_name) LEFT JOIN b USING (dataset_name)",
)(lambda s: reports.dataset_details(s, _NOW))
_query(
    "dataset_overview",
    f"WITH {_SETS}, d AS (SELECT *, last_used > TIMESTAMP '{_NOW}' - INTERVAL 12 DAY AS active FROM k LEFT JOIN v USING (dataset_name)), t AS (SELECT *, date_diff('second', start_time, TIMESTAMP '{_NOW}') / 86400.0 AS age FROM sessions) "
    f"SELECT {_int('count(*)', 'datasets')}, {_int('count(*) FILTER (active)', 'active')}, {_int('count(*) FILTER (NOT active)', 'inactive')}, {_int('sum(n_sessions)', 'sessions')}, {_int('sum(n_features)', 'features')}, {_num('avg(n_sessions)', 'sessions_a_dataset')}, {_num('avg(n_features)', 'features_a_dataset')}, {_num('avg(100.0 * n_completed / n_sessions) FILTER (n_completed > 0)', 'avg_success_rate')}, {_int('sum(n_completed)', 'completed')}, "
    f"{_num('(SELECT avg(best_score) FROM t WHERE status = $$completed$$ AND best_score <> 0)', 'avg_score')}, {_num('max(best_score)', 'best_score')}, {_int('(SELECT count(*) FROM t WHERE age < 1)', 'sessions_1d')}, {_int('(SELECT count(*) FROM t WHERE age < 7)', 'sessions_7d')}, {_int('(SELECT count(*) FROM t WHERE age < 30)', 'sessions_30d')} FROM d",
)(lambda s: reports.dataset_overview(s, _NOW, 12, None))
_query(
    "resource_usage",
    f"SELECT session_id, {_int('date_diff($$second$$, min(ts), max(ts))', 'duration')}, {_num('avg(memory_mb)', 'avg_mb')}, {_num('max(memory_mb)', 'max_mb')}, {_int('count(DISTINCT node_id)', 'nodes')}, {_int('count(DISTINCT operation)', 'operations')}, {_int('(SELECT max(n) FROM (SELECT count(*) AS n FROM history g WHERE g.session_id = h.session_id GROUP BY g.iteration))', 'most_active')} FROM history h GROUP BY session_id",
)(reports.resource_usage)

_CHECKS = """
 SELECT session_id, 'node ids' AS "check", count(*) AS total, count(*) FILTER (node_id IS NULL) AS bad FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'parents', count(*) FILTER (iteration > 0), count(*) FILTER (iteration > 0 AND parent_id IS NULL) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'visits', count(*), count(*) FILTER (visits IS NULL OR visits <= 1) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'feature changes', count(*) FILTER (iteration > 0), count(*) FILTER (iteration > 0 AND coalesce(features_after = had, true)) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'growth', max(iteration) - min(iteration) + 1, CASE WHEN max(iteration) > min(iteration) THEN 0 ELSE 1 END FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'one root', count(*) FILTER (iteration = 0), abs(count(*) FILTER (iteration = 0) - 1) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'root without parent', count(*) FILTER (iteration = 0), count(parent_id) FILTER (iteration = 0) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'iterations from 0', count(*), CASE WHEN min(iteration) = 0 THEN 0 ELSE 1 END FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'ids without gaps', count(DISTINCT node_id), max(node_id) - min(node_id) + 1 - count(DISTINCT node_id) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'parents exist', count(*) FILTER (iteration > 0), count(*) FILTER (iteration > 0 AND above IS NULL) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'parents before children', count(*) FILTER (iteration > 0), count(*) FILTER (iteration > 0 AND above >= iteration) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'scores', count(score), count(*) FILTER (score < 0 OR score > 1) FROM e GROUP BY 1 UNION ALL
 SELECT session_id, 'feature counts', count(*) FILTER (iteration > 0), CASE WHEN count(DISTINCT operation) FILTER (iteration > 0) >= 0.8 * count(*) FILTER (iteration > 0) THEN 0 ELSE count(*) FILTER (iteration > 0 AND json_array_length(features_after) < root) END FROM e GROUP BY 1"""
_query(
    "validation",
    "WITH e AS (SELECT h.*, p.iteration AS above, p.features_after AS had, json_array_length((SELECT arg_min(r.features_after, r.node_id) FROM history r WHERE r.session_id = h.session_id AND r.iteration = 0)) AS root FROM history h LEFT JOIN history p ON p.session_id = h.session_id AND p.node_id = h.parent_id), "
    f"c AS ({_CHECKS}) SELECT session_id, \"check\", {_int('total', 'total')}, {_int('bad', 'bad')}, CASE WHEN \"check\" IN ('visits', 'feature changes') THEN CASE WHEN bad < total THEN 'PASS' ELSE 'FAIL' END WHEN \"check\" = 'scores' AND total = 0 THEN 'FAIL' WHEN bad = 0 THEN 'PASS' WHEN \"check\" = 'growth' OR (\"check\" = 'parents' AND bad < total) THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM c",
)(reports.validation)
_query(
    "session_depths",
    "WITH RECURSIVE t AS (SELECT node_id, session_id, 0 AS depth FROM history WHERE parent_id IS NULL UNION ALL SELECT h.node_id, h.session_id, t.depth + 1 FROM history h JOIN t ON h.parent_id = t.node_id) SELECT session_id, CAST(max(depth) AS BIGINT) AS depth FROM t GROUP BY session_id",
)(reports.deepest)


def _hashed(s: store.Store) -> store.Store:
    """Long session ids; a third keeps the names that several share."""
    return replace(s, sessions=s.sessions.withColumns({"session_id": F.md5(F.col("session_id").cast("binary")), "session_name": F.when(F.col("total_iterations") % 3 == 0, F.col("session_name")).otherwise(F.col("session_id"))}))


_query(
    "resolve_sessions",
    "WITH s AS (SELECT md5(session_id) AS id, CASE WHEN total_iterations % 3 = 0 THEN session_name ELSE session_id END AS name, start_time FROM sessions), a AS (SELECT DISTINCT substr(md5('s' || CAST(feature_no % 60 AS VARCHAR)), 1, CAST(4 + feature_no % 29 AS INT)) AS text FROM catalog UNION SELECT DISTINCT 's' || CAST(feature_no % 60 AS VARCHAR) FROM catalog UNION SELECT name FROM s UNION SELECT md5(session_id) FROM history UNION SELECT 'latest'), "
    "m AS (SELECT text, id, CASE WHEN text = 'latest' AND id = (SELECT id FROM s ORDER BY start_time DESC, id LIMIT 1) THEN 0 WHEN text = id THEN 1 WHEN length(text) >= 6 AND starts_with(id, text) THEN 2 WHEN text = name THEN 3 END AS way FROM a, s), "
    "w AS (SELECT text, min(way) AS way FROM m GROUP BY text) SELECT text, CASE WHEN count(id) = 1 THEN min(id) END AS session_id, ['latest', 'id', 'beginning', 'name'][w.way + 1] AS how, CAST(count(id) AS BIGINT) AS n FROM w LEFT JOIN m USING (text, way) GROUP BY text, w.way",
)(
    lambda s: reports.resolve(
        _hashed(s),
        s.catalog.select(F.expr("substr(md5('s' || feature_no % 60), 1, cast(4 + feature_no % 29 as int))").alias("text")).union(s.catalog.select(F.expr("'s' || feature_no % 60"))).union(_hashed(s).sessions.select("session_name")).union(s.history.select(F.md5(F.col("session_id").cast("binary")))).union(s.catalog.select(F.lit("latest"))),
    )
)
_query(
    "uniform_iterations",
    f"SELECT iteration, {_int('count(*)', 'n')}, {_int('count(DISTINCT json_array_length(features_after))', 'counts')} FROM history GROUP BY iteration HAVING count(*) > 1 AND count(DISTINCT json_array_length(features_after)) <= 14",
)(lambda s: reports.uniform_iterations(s, 14))
_query("health_traps_of_double_scores", f"SELECT p.node_id, {_int('count(*)', 'n_children')} FROM history p JOIN history c ON c.parent_id = p.node_id WHERE 2 * p.score > 0.7 AND p.visits > 3 GROUP BY p.node_id, p.score HAVING count(*) >= 2 AND avg(c.score) < 0.8 * p.score")(
    lambda s: store.health_traps(replace(s, history=s.history.withColumn("score", 2 * F.col("score"))))
)
_query("search_features_by_pattern", f"SELECT feature_no, feature_name, category, {_int('2', 'relevance')} FROM catalog WHERE regexp_matches(feature_name, '^f_Brand#1.*_1.$')")(lambda s: store.search_features(s, "f_brand#1*_1?"))
_query(
    "unused_share",
    f"SELECT category, {_int('count(*)', 'features')}, {_int('count(*) FILTER (feature_no NOT IN (SELECT feature_no FROM impact))', 'unused')}, {_num('count(*) FILTER (feature_no NOT IN (SELECT feature_no FROM impact)) / CAST(count(*) AS DOUBLE)', 'share')} FROM catalog GROUP BY category",
)(reports.unused_share)

QUERIES = {k: _ALL[k] for k in _ALL if k not in _before}
SQL = {k: _ALL_SQL[k] for k in QUERIES}

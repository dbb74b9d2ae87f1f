"""Queries over a store of recorded searches by name; the SQL beside each says the same in another form."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .plans import analytics, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _with_tables(q: str) -> str:
    used = [f"{t} AS ({body})" for t, body in analytics.SOURCES.items() if re.search(rf"\b{t}\b", q)]
    own = re.match(r"WITH (RECURSIVE )?", q)
    return f"WITH {own[1] or ''}" + ", ".join([*used, q[own.end() :]]) if own else "WITH " + ", ".join(used) + " " + q


def _query(name: str, sql: str, digits: int = 6):
    def add(f):
        def run(spark, sf_dir):
            df = f(store.from_sales(spark, sf_dir))
            whole = ("int", "smallint")
            return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in whole else F.col(c) for c, t in df.dtypes])

        QUERIES[f"store_{name}"] = run
        SQL[f"store_{name}"] = _with_tables(sql)
        return f

    return add


def _num(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) AS {name}"


def _int(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


_STATS = """s AS (SELECT c.feature_no, c.feature_name, c.category, count(i.delta) AS uses, count(DISTINCT i.session_id) AS n_sessions, avg(i.delta) AS avg_impact, sum(i.delta) AS total_impact, max(i.delta) AS best_impact,
 CAST(count(*) FILTER (i.delta > 0) AS DOUBLE) / nullif(count(i.delta), 0) AS success_rate FROM catalog c LEFT JOIN impact i ON c.feature_no = i.feature_no GROUP BY c.feature_no, c.feature_name, c.category)"""
_OUT = f"feature_no, feature_name, category, {_int('uses', 'uses')}, {_int('n_sessions', 'n_sessions')}, {_num('avg_impact', 'avg_impact')}, {_num('total_impact', 'total_impact')}, {_num('best_impact', 'best_impact')}, {_num('success_rate', 'success_rate')}"

_query("feature_rankings", f"WITH {_STATS}, r AS (SELECT *, row_number() OVER (ORDER BY round(avg_impact, 9) DESC, feature_name) AS rank FROM s WHERE n_sessions >= 3) SELECT {_OUT}, rank FROM r WHERE rank <= 20")(store.feature_rankings)
_query("feature_rankings_by_use", f"WITH {_STATS}, r AS (SELECT *, row_number() OVER (ORDER BY uses DESC, feature_name) AS rank FROM s WHERE n_sessions >= 5) SELECT {_OUT}, rank FROM r WHERE rank <= 7")(lambda s: store.feature_rankings(s, 5, "uses", 7))
_query("list_features", f"WITH {_STATS}, r AS (SELECT *, row_number() OVER (ORDER BY best_impact NULLS LAST, feature_name) AS k FROM s WHERE contains(lower(feature_name), 'brand#1') AND uses >= 1 AND avg_impact >= -0.05) SELECT {_OUT} FROM r WHERE k BETWEEN 6 AND 15")(
    lambda s: store.list_features(s, name_like="f_BRAND#1*", least_impact=-0.05, least_uses=1, order="best_impact", descending=False, limit=10, offset=5)
)
_query("features_of_category", f"WITH {_STATS} SELECT {_OUT} FROM s WHERE category = (SELECT min(category) FROM catalog)")(lambda s: store.list_features(s, category=s.catalog.agg(F.min("category")).first()[0]))
_query("search_features", f"SELECT feature_no, feature_name, category, {_int("CASE WHEN regexp_matches(feature_name, 'Brand#3.*_1.$') THEN 2 WHEN regexp_matches(category, 'Brand#3.*_1.$') THEN 3 END", 'relevance')} FROM catalog WHERE regexp_matches(feature_name, '^f_Brand#3.*_1.$')")(lambda s: store.search_features(s, "f_brand#3*_1?"))
_query("fuzzy_search", f"WITH f AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(['b', '4', '3', '7']) AS x) WHERE contains(lower(feature_name), x)) / 4.0 AS share FROM catalog) SELECT feature_no, feature_name, category, {_int("CASE WHEN contains(lower(feature_name), 'b437') THEN 2 WHEN contains(lower(category), 'b437') THEN 3 ELSE 4 END", 'relevance')} FROM f WHERE share >= 0.6")(lambda s: store.search_features(s, "b437", fuzzy=0.6))

_MATRIX = ["d0", "d1", "d2", "d3", "d4"]
_query("impact_matrix", f"WITH {_STATS}, b AS (SELECT feature_no, feature_name FROM s WHERE uses > 0 ORDER BY round(abs(avg_impact), 9) DESC, feature_name LIMIT 8) SELECT feature_name, " + ", ".join(_num(f"avg(delta) FILTER (dataset_name = '{d}')", d) for d in _MATRIX) + " FROM b JOIN impact USING (feature_no) JOIN sessions USING (session_id) GROUP BY feature_name")(lambda s: store.impact_matrix(s, _MATRIX, 8))

_PAIRS = "p AS (SELECT u.feature_no, i.feature_no AS paired, count(DISTINCT i.session_id) AS n_sessions, avg(i.delta) AS avg_impact FROM (SELECT DISTINCT session_id, feature_no FROM impact) u JOIN impact i ON u.session_id = i.session_id AND u.feature_no <> i.feature_no GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY feature_no ORDER BY round(avg_impact, 9) DESC, paired) AS place FROM p)"
_query("combinations", f"WITH {_PAIRS} SELECT feature_no, paired, {_int('n_sessions', 'n_sessions')}, {_num('avg_impact', 'avg_impact', 9)}, {_int('place', 'place')} FROM q WHERE place <= 3", 9)(lambda s: store.combinations(s, 3))
_query(
    "recommendations",
    f"WITH {_STATS}, {_PAIRS}, mine AS (SELECT DISTINCT feature_no FROM impact WHERE session_id = 's7'), top AS (SELECT * FROM s WHERE n_sessions >= 1 ORDER BY round(avg_impact, 9) DESC, feature_name LIMIT 200), y AS (SELECT feature_no, sum(avg_impact) AS syn FROM q WHERE place <= 5 AND paired IN (SELECT feature_no FROM mine) GROUP BY feature_no), "
    f"z AS (SELECT feature_name, avg_impact, success_rate, coalesce(syn, 0) AS synergy, avg_impact + 0.5 * coalesce(syn, 0) AS recommendation FROM top LEFT JOIN y USING (feature_no) WHERE feature_no NOT IN (SELECT feature_no FROM mine) ORDER BY round(recommendation, 9) DESC, feature_name LIMIT 10) SELECT feature_name, {_num('avg_impact', 'avg_impact')}, {_num('success_rate', 'success_rate')}, {_num('synergy', 'synergy')}, {_num('recommendation', 'recommendation')} FROM z",
)(lambda s: store.recommendations(s, "s7", top=200))
_query("feature_trend", f"WITH r AS (SELECT feature_no, list(delta ORDER BY weight DESC, session_id DESC, delta DESC) AS l FROM impact GROUP BY feature_no), a AS (SELECT feature_no, list_avg(l[1:10]) AS x, list_avg(l[11:20]) AS y FROM r) SELECT feature_no, {_num('x', 'recent_avg')}, {_num('y', 'older_avg')}, CASE WHEN y IS NULL THEN 'stable' WHEN x > y THEN 'improving' ELSE 'declining' END AS trend FROM a")(store.feature_trend)
_query("catalog_summary", f"WITH {_STATS}, m AS (SELECT 'most used' AS section, feature_name AS name, CAST(uses AS DOUBLE) AS value FROM s ORDER BY uses DESC, feature_name LIMIT 5) SELECT 'totals' AS section, 'features' AS name, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'totals', 'used', count(*) FROM s WHERE uses > 0 UNION ALL SELECT 'totals', 'positive', count(*) FROM s WHERE avg_impact > 0 UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY category UNION ALL SELECT * FROM m")(store.catalog_summary)

_DONE = "status = 'completed'"


def _period(name: str, where: str) -> str:
    return (
        f"{name} AS (SELECT count(*) AS n, count(*) FILTER ({_DONE}) AS done, coalesce(avg(coalesce(best_score, 0)) FILTER ({_DONE}), 0) AS a, coalesce(max(best_score) FILTER ({_DONE}), 0) AS m, coalesce(sum(total_iterations), 0) AS i, coalesce(sum(seconds), 0) AS t FROM sessions WHERE {where}), "
        f"{name}2 AS (SELECT unnest(['total_sessions', 'completed_sessions', 'success_rate', 'avg_score', 'max_score', 'total_iterations', 'total_time']) AS metric, unnest([CAST(n AS DOUBLE), done, done / greatest(n, 1), a, m, i, t]) AS v FROM {name})"
    )


_query(
    "compare_periods",
    "WITH " + _period("a", "CAST(start_time AS DATE) BETWEEN '1996-01-05' AND '1996-02-10'") + ", " + _period("b", "CAST(start_time AS DATE) BETWEEN '1996-02-11' AND '1996-04-15'")
    + f" SELECT metric, {_num('a2.v', 'first')}, {_num('b2.v', 'second')}, {_num('a2.v - b2.v', 'absolute')}, {_num('CASE WHEN b2.v > 0 THEN (a2.v - b2.v) / b2.v * 100 ELSE 0 END', 'percentage')}, CASE WHEN metric IN ('success_rate', 'avg_score', 'max_score') THEN a2.v > b2.v ELSE a2.v < b2.v END AS improved FROM a2 JOIN b2 USING (metric)",
)(lambda s: store.compare_periods(s, ("1996-01-05", "1996-02-10"), ("1996-02-11", "1996-04-15")))
_query(
    "performance_summary",
    f"WITH {_STATS}, r AS (SELECT *, date_diff('day', CAST(start_time AS DATE), DATE '1996-03-20') AS age FROM sessions), w AS (SELECT * FROM r WHERE age BETWEEN 0 AND 60), f AS (SELECT count(*) AS features, count(*) FILTER (avg_impact > 0) AS positive_features, avg(avg_impact) AS avg_impact, max(avg_impact) AS best_impact FROM s WHERE uses > 0) "
    f"SELECT CAST(count(*) AS DOUBLE) AS total_sessions, CAST(count(*) FILTER ({_DONE}) AS DOUBLE) AS completed_sessions, {_num(f'count(*) FILTER ({_DONE}) / greatest(count(*), 1)', 'success_rate')}, {_num(f'coalesce(avg(best_score) FILTER ({_DONE}), 0)', 'avg_score')}, {_num(f'coalesce(max(best_score) FILTER ({_DONE}), 0)', 'max_score')}, CAST(coalesce(sum(total_iterations), 0) AS DOUBLE) AS total_iterations, CAST(coalesce(sum(seconds), 0) AS DOUBLE) AS total_time, "
    f"{_int('count(*) FILTER (age < 1)', 'sessions_1d')}, {_int('count(*) FILTER (age < 7)', 'sessions_7d')}, {_int('any_value(features)', 'features')}, {_int('any_value(positive_features)', 'positive_features')}, {_num('any_value(f.avg_impact)', 'avg_impact')}, {_num('any_value(f.best_impact)', 'best_impact')} FROM w, f",
)(lambda s: store.performance_summary(s, "1996-03-20", 60))

_SESSIONS = f"l AS (SELECT session_id, status, dataset_name, best_score, total_iterations, (SELECT count(*) FROM history h WHERE h.session_id = x.session_id) AS nodes, (SELECT count(DISTINCT operation) FROM history h WHERE h.session_id = x.session_id) AS operations, best_score * 3600 / nullif(seconds, 0) AS score_per_hour FROM sessions x)"
_LIST = f"session_id, status, dataset_name, {_num('best_score', 'best_score')}, total_iterations, {_int('nodes', 'nodes')}, {_int('operations', 'operations')}, {_num('score_per_hour', 'score_per_hour', 9)}"
_query("list_sessions", f"WITH {_SESSIONS} SELECT {_LIST} FROM (SELECT * FROM l WHERE status = 'completed' AND best_score >= 0.2 ORDER BY best_score DESC, session_id LIMIT 10)", 9)(lambda s: store.list_sessions(s, "completed", least_score=0.2))
_query("compare_sessions", f"WITH {_SESSIONS}, k AS (SELECT * FROM l WHERE session_id IN ('s1', 's2', 's39')) SELECT {_LIST}, {_num('(SELECT max(best_score) FROM k) - best_score', 'behind')} FROM k", 9)(lambda s: store.compare_sessions(s, ["s1", "s2", "s39"]))
_query("cleanup_candidates", f"SELECT session_id, CASE WHEN status = 'interrupted' THEN 'interrupted' WHEN status = 'active' AND total_iterations = 0 THEN 'no progress' ELSE 'test' END AS reason, {_int('(SELECT count(*) FROM history h WHERE h.session_id = x.session_id)', 'n_history')}, {_int('(SELECT count(*) FROM impact i WHERE i.session_id = x.session_id)', 'n_impact')} FROM sessions x WHERE status = 'interrupted' OR (status = 'active' AND total_iterations = 0) OR is_test_mode")(store.cleanup_candidates)
_query("sessions_left", "SELECT session_id FROM sessions WHERE NOT (status = 'interrupted' OR (status = 'active' AND total_iterations = 0) OR is_test_mode)")(lambda s: store.without_sessions(s, store.cleanup_candidates(s)).sessions.select("session_id"))

_TREE = "RECURSIVE t AS (SELECT node_id, 0 AS depth FROM history WHERE parent_id IS NULL OR parent_id = node_id UNION ALL SELECT h.node_id, t.depth + 1 FROM history h JOIN t ON h.parent_id = t.node_id WHERE h.node_id <> h.parent_id)"
_query("tree_stats", f"WITH {_TREE} SELECT {_int('depth', 'depth')}, {_int('count(*)', 'nodes')}, {_num('avg(score)', 'avg_score')}, {_num('max(score)', 'best_score')}, {_int('count(DISTINCT json_array_length(features_after))', 'feature_counts')} FROM t JOIN history USING (node_id) GROUP BY depth")(store.tree_stats)
_query("tree_balance", f"WITH {_TREE}, d AS (SELECT depth, count(*) AS w FROM t GROUP BY depth) SELECT {_int('max(depth)', 'depth')}, {_int('max(w)', 'most_wide')}, {_num('avg(w)', 'avg_width')}, max(depth) > 50 OR max(w) > 100 OR (avg(w) < 2 AND max(depth) > 10) AS unbalanced FROM d")(store.tree_balance)
_query("iteration_gaps", "WITH i AS (SELECT DISTINCT session_id, iteration FROM history), g AS (SELECT a.session_id, a.iteration AS after, (SELECT min(b.iteration) FROM i b WHERE b.session_id = a.session_id AND b.iteration > a.iteration) AS before FROM i a) SELECT session_id, after, before, before - after - 1 AS missing FROM g WHERE before - after > 1")(store.iteration_gaps)
_query("feature_success", f"WITH g AS (SELECT features_after, score - lag(score) OVER (PARTITION BY session_id ORDER BY iteration, node_id) AS gain FROM history), e AS (SELECT gain, unnest(from_json(features_after, '[\"VARCHAR\"]')) AS feature FROM g WHERE gain IS NOT NULL) SELECT feature, {_int('count(*)', 'uses')}, {_int('count(*) FILTER (gain > 0)', 'successes')}, {_num('sum(gain)', 'gain')} FROM e GROUP BY feature")(store.feature_success)
_query("feature_mode", f"SELECT {_int('count(DISTINCT category)', 'operations')}, {_int('count(DISTINCT category)', 'total')}, {_num('count(*) / CAST(count(DISTINCT category) AS DOUBLE)', 'avg_features')}, count(DISTINCT category) > 50 AND count(*) <= 1.5 * count(DISTINCT category) AS single FROM catalog")(store.feature_mode)
_query(
    "timing",
    f"WITH l AS (SELECT operation, list(seconds ORDER BY node_id DESC)[1:100] AS x FROM history GROUP BY operation), h AS (SELECT operation, x, len(x) AS m, list_avg(x[len(x) - len(x) // 2 + 1 :]) AS a, list_avg(x[: len(x) - len(x) // 2]) AS b FROM l) SELECT operation, {_int('n', 'n')}, {_num('total', 'total')}, {_num('least', 'least')}, {_num('most', 'most')}, {_num('list_aggregate(x, \'quantile_cont\', 0.5)', 'p50')}, {_num('list_aggregate(x, \'quantile_cont\', 0.9)', 'p90')}, {_num('list_aggregate(x, \'quantile_cont\', 0.95)', 'p95')}, "
    f"CASE WHEN m < 10 OR a = 0 THEN 'stable' WHEN b > 1.1 * a THEN 'increasing' WHEN b < 0.9 * a THEN 'decreasing' ELSE 'stable' END AS trend, {_num('list_max(x) / nullif(list_min(x), 0)', 'stability')} FROM h JOIN (SELECT operation, count(*) AS n, sum(seconds) AS total, min(seconds) AS least, max(seconds) AS most FROM history GROUP BY operation) USING (operation)",
)(store.timing)

_query(
    "health_exploration",
    f"WITH i AS (SELECT session_id, iteration, count(DISTINCT node_id) AS n, max(visits) AS v, stddev_samp(visits) AS s FROM history GROUP BY session_id, iteration), l AS (SELECT * FROM i WHERE iteration > 10 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY iteration DESC) <= 10), a AS (SELECT session_id, avg(n) AS n, max(v) AS v, avg(s) AS s FROM l GROUP BY session_id) "
    f"SELECT session_id, {_num('n', 'avg_nodes')}, {_int('v', 'most_visits')}, {_num('s', 'avg_spread')}, concat_ws(';', CASE WHEN n < 2 THEN 'few nodes' END, CASE WHEN v > 50 THEN 'visits in one place' END, CASE WHEN s < 1 THEN 'little variance' END) AS issues FROM a",
)(store.health_exploration)
_query("health_traps", f"SELECT p.node_id, {_int('count(*)', 'n_children')} FROM history p JOIN history c ON c.parent_id = p.node_id WHERE p.score > 0.25 AND p.visits > 3 GROUP BY p.node_id, p.score HAVING count(*) >= 2 AND avg(c.score) < 0.8 * p.score")(lambda s: store.health_traps(s, score=0.25))
_query("health_traps_as_published", f"SELECT p.node_id, {_int('count(*)', 'n_children')} FROM history p JOIN history c ON c.parent_id = p.node_id WHERE p.score > 0.7 AND p.visits > 3 GROUP BY p.node_id, p.score HAVING count(*) >= 2 AND avg(c.score) < 0.8 * p.score")(store.health_traps)
_query(
    "health_memory",
    f"WITH i AS (SELECT session_id, iteration, count(*) AS n, avg(memory_mb) AS a, max(memory_mb) AS m FROM history GROUP BY session_id, iteration), l AS (SELECT session_id, list(a ORDER BY iteration) FILTER (a IS NOT NULL) AS x, max(m) AS m, sum(n) AS n FROM i GROUP BY session_id), g AS (SELECT session_id, m, n, CASE WHEN len(x) > 10 THEN list_avg(x[len(x) // 2 + 1 :]) / list_avg(x[: len(x) // 2]) ELSE 1 END AS r FROM l) "
    f"SELECT session_id, {_num('m', 'most_mb')}, {_num('r', 'growth')}, {_int('n', 'n_nodes')}, concat_ws(';', CASE WHEN m > 1000 THEN 'much memory' END, CASE WHEN r > 2 THEN 'growing memory' END, CASE WHEN n > 10000 THEN 'large tree' END) AS issues FROM g",
)(store.health_memory)
_query(
    "health_ucb",
    f"WITH u AS (SELECT count(*) AS n, 1 - count(ucb) / CAST(count(*) AS DOUBLE) AS g, count(*) FILTER (ucb < 0) AS neg, count(*) FILTER (isinf(ucb) AND ucb > 0) AS inf, max(ucb) FILTER (NOT isinf(ucb)) AS m FROM history) SELECT {_int('n', 'n')}, {_num('g', 'missing')}, {_int('neg', 'negative')}, {_int('inf', 'infinite')}, {_num('m', 'most')}, concat_ws(';', CASE WHEN g > 0.1 THEN 'missing' END, CASE WHEN neg > 0 THEN 'negative' END, CASE WHEN inf = 0 AND n > 10 THEN 'none infinite' END, CASE WHEN m > 10 THEN 'too large' END) AS issues FROM u",
)(store.health_ucb)

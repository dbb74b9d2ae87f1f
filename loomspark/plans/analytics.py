"""Analytics over recorded searches, as SQL that Spark and other engines run alike.

The store's tables are named in each query and given by views: here they are derived from the sales tables, so that
every query has data of any size. `run` registers the sales tables and runs a query by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "sessions": """SELECT 's' || CAST(c_custkey % 40 AS VARCHAR(9)) AS session_id, CASE WHEN min(c_nationkey) % 4 = 0 THEN 'interrupted' ELSE 'completed' END AS status,
        'd' || CAST(max(c_nationkey) % 5 AS VARCHAR(9)) AS dataset_name, CAST(CASE WHEN c_custkey % 40 % 9 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS total_iterations, max(c_acctbal) / 10000 AS best_score, 'run ' || CAST(c_custkey % 40 % 7 AS VARCHAR(9)) AS session_name, c_custkey % 40 % 11 = 5 AS is_test_mode,
        CAST(DATE '1996-01-01' + CAST(c_custkey % 40 * 3 AS INT) AS TIMESTAMP) AS start_time, CAST(60 * (1 + c_custkey % 40) AS DOUBLE) AS seconds FROM customer GROUP BY c_custkey % 40""",
    "history": """SELECT o_orderkey AS node_id, CASE WHEN o_orderkey <= 1 THEN NULL ELSE CAST(floor(o_orderkey / 3) AS BIGINT) END AS parent_id, 's' || CAST(o_custkey % 40 AS VARCHAR(9)) AS session_id,
        CAST(floor(o_orderkey / 25) AS BIGINT) AS iteration, o_orderpriority AS operation, o_totalprice / 1000000 AS score, CAST(o_custkey % 60 AS BIGINT) AS visits, o_orderdate AS ts, CAST(o_orderkey % 7 AS DOUBLE) AS seconds,
        o_totalprice / 300 AS memory_mb, CASE WHEN o_custkey % 60 = 0 THEN CAST('infinity' AS DOUBLE) WHEN o_custkey % 60 = 7 THEN NULL ELSE o_totalprice / 100000 END AS ucb, '[' || repeat('1,', CAST(o_custkey % 35 AS INT)) || '0]' AS features_after FROM orders""",
    "impact": """SELECT 's' || CAST(l_orderkey % 40 AS VARCHAR(9)) AS session_id, CAST(l_partkey % 300 AS BIGINT) AS feature_no, l_discount - 0.05e0 AS delta, l_extendedprice AS weight FROM lineitem""",
    "catalog": """SELECT CAST(p_partkey % 320 AS BIGINT) AS feature_no, 'f_' || min(p_brand) || '_' || CAST(p_partkey % 320 AS VARCHAR(9)) AS feature_name, min(p_type) AS category, max(p_size) AS cost,
        CASE p_partkey % 320 % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'int' ELSE 'float' END AS data_type, p_partkey % 320 % 17 <> 3 AS is_active FROM part GROUP BY p_partkey % 320""",
}

QUERIES = {
    # rankings and catalogue
    "feature_rankings": "SELECT feature_name, round(avg(delta), 6) AS avg_impact, CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions, CAST(count(*) AS BIGINT) AS n FROM impact JOIN catalog USING (feature_no) GROUP BY feature_name HAVING count(DISTINCT session_id) >= 3",
    "features_with_stats": "SELECT c.feature_name, c.category, CAST(count(i.delta) AS BIGINT) AS n, round(avg(i.delta), 6) AS avg_impact FROM catalog c LEFT JOIN impact i ON c.feature_no = i.feature_no GROUP BY c.feature_name, c.category",
    "features_of_session": "SELECT DISTINCT feature_name FROM impact JOIN catalog USING (feature_no) WHERE session_id = 's7'",
    "unused_features": "SELECT c.feature_no, c.feature_name FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM impact i WHERE i.feature_no = c.feature_no)",
    "cooccurrence": "WITH u AS (SELECT DISTINCT session_id, feature_no FROM impact) SELECT a.feature_no AS a, b.feature_no AS b, CAST(count(*) AS BIGINT) AS n FROM u a JOIN u b ON a.session_id = b.session_id AND a.feature_no < b.feature_no GROUP BY a.feature_no, b.feature_no",
    "impact_by_dataset": "SELECT dataset_name, feature_no, round(avg(delta), 6) AS avg_impact, round(max(delta), 6) AS max_impact FROM impact JOIN sessions USING (session_id) GROUP BY dataset_name, feature_no",
    "category_stats": "SELECT category, CAST(count(DISTINCT c.feature_no) AS BIGINT) AS n_features, round(sum(delta * weight) / nullif(sum(weight), 0e0), 6) AS weighted_impact FROM catalog c JOIN impact i ON c.feature_no = i.feature_no GROUP BY category",
    "catalog_stats": "SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(min(cost) AS BIGINT) AS min_cost, CAST(max(cost) AS BIGINT) AS max_cost, round(avg(cost), 6) AS avg_cost FROM catalog GROUP BY category",
    # sessions
    "session_counts": "SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(sum(total_iterations) AS BIGINT) AS iterations, round(avg(best_score), 6) AS avg_best FROM sessions GROUP BY status",
    "session_overview": "SELECT session_id, CAST(count(*) AS BIGINT) AS n, CAST(min(iteration) AS BIGINT) AS first_iteration, CAST(max(iteration) AS BIGINT) AS last_iteration, round(max(score), 6) AS best, round(avg(score), 6) AS avg_score, round(stddev_samp(score), 6) AS std FROM history GROUP BY session_id",
    "session_success": "SELECT dataset_name, round(CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS success FROM sessions GROUP BY dataset_name",
    "datasets_with_sessions": "SELECT s.dataset_name, CAST(count(DISTINCT s.session_id) AS BIGINT) AS n_sessions, CAST(count(h.node_id) AS BIGINT) AS n_nodes FROM sessions s LEFT JOIN history h ON s.session_id = h.session_id GROUP BY s.dataset_name",
    "daily_trends": "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS avg_score, round(max(score), 6) AS best FROM history GROUP BY CAST(ts AS DATE)",
    "weekday_lag": "WITH d AS (SELECT date_trunc('month', ts) AS m, session_id, avg(score) AS a FROM history GROUP BY date_trunc('month', ts), session_id) SELECT CAST(m AS DATE) AS month, session_id, round(a, 6) AS a, round(a - lag(a) OVER (PARTITION BY session_id ORDER BY m), 6) AS change FROM d",
    # operations
    "operation_metrics": "SELECT operation, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS avg_score, round(max(score), 6) AS best, round(stddev_samp(score), 6) AS std, CASE WHEN stddev_samp(score) < 0.01e0 THEN 'High' WHEN stddev_samp(score) < 0.05e0 THEN 'Medium' ELSE 'Low' END AS consistency FROM history GROUP BY operation",
    "operation_efficiency": "SELECT operation, round(avg(score) / nullif(avg(seconds), 0e0), 6) AS efficiency FROM history GROUP BY operation",
    "improvement_over_parent": "SELECT c.operation, CAST(count(*) AS BIGINT) AS n, round(avg(c.score - p.score), 6) AS gain FROM history c JOIN history p ON c.parent_id = p.node_id GROUP BY c.operation",
    "feature_steps": "SELECT operation, round(avg(d), 6) AS avg_step FROM (SELECT operation, score - lag(score) OVER (PARTITION BY session_id ORDER BY node_id) AS d FROM history) t GROUP BY operation",
    "timing_stats": "SELECT operation, CAST(count(*) AS BIGINT) AS n, round(sum(seconds), 6) AS total, min(seconds) AS least, max(seconds) AS most, round(median(seconds), 6) AS p50 FROM history GROUP BY operation",
    # convergence
    "running_best": "SELECT session_id, node_id, round(greatest(max(score) OVER (PARTITION BY session_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0), 6) AS best FROM history",
    "plateaus": "WITH b AS (SELECT session_id, node_id, max(score) OVER (PARTITION BY session_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM history) SELECT session_id, round(best, 6) AS best, CAST(count(*) AS BIGINT) AS length, min(node_id) AS first_node FROM b GROUP BY session_id, best HAVING count(*) >= 10",
    "milestones": "WITH t AS (SELECT session_id, max(score) AS m FROM history GROUP BY session_id) SELECT h.session_id, min(CASE WHEN score >= 0.5e0 * m THEN node_id END) AS half, min(CASE WHEN score >= 0.9e0 * m THEN node_id END) AS most, min(CASE WHEN score = m THEN node_id END) AS best FROM history h JOIN t ON h.session_id = t.session_id GROUP BY h.session_id",
    "recent_trend": "WITH r AS (SELECT session_id, score, row_number() OVER (PARTITION BY session_id ORDER BY node_id DESC) AS k FROM history) SELECT session_id, round(avg(CASE WHEN k <= 7 THEN score END) - avg(CASE WHEN k BETWEEN 8 AND 14 THEN score END), 6) AS trend FROM r WHERE k <= 14 GROUP BY session_id",
    # tree and health
    "health_orphans": "SELECT CAST(count(*) AS BIGINT) AS orphans FROM history c WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM history p WHERE p.node_id = c.parent_id)",
    "health_roots": "SELECT CAST(count(*) AS BIGINT) AS roots FROM history WHERE parent_id IS NULL",
    "health_diversity": "SELECT iteration, CAST(count(DISTINCT operation) AS BIGINT) AS kinds, CAST(count(*) AS BIGINT) AS n FROM history GROUP BY iteration HAVING count(*) > 1 AND CAST(count(DISTINCT operation) AS DOUBLE) / count(*) < 0.5e0",
    "health_scores": "SELECT CAST(sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN score < 0 OR score > 1 THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM history",
    "health_convergence": "WITH m AS (SELECT session_id, iteration, max(score) AS s FROM history GROUP BY session_id, iteration), d AS (SELECT session_id, s - lag(s) OVER (PARTITION BY session_id ORDER BY iteration) AS g FROM m) SELECT session_id, CAST(sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM d GROUP BY session_id",
    "health_propagation": "SELECT CAST(count(*) AS BIGINT) AS parents, CAST(sum(CASE WHEN v > 1.5e0 * pv THEN 1 ELSE 0 END) AS BIGINT) AS heavy, CAST(sum(CASE WHEN abs(ps - a) > 0.3e0 THEN 1 ELSE 0 END) AS BIGINT) AS far FROM (SELECT p.node_id, p.visits AS pv, p.score AS ps, sum(c.visits) AS v, avg(c.score) AS a FROM history p JOIN history c ON c.parent_id = p.node_id GROUP BY p.node_id, p.visits, p.score) t",
    "visit_distribution": "SELECT visits, CAST(count(*) AS BIGINT) AS n FROM history GROUP BY visits",
    "best_score_check": "SELECT s.session_id, round(s.best_score, 6) AS recorded, round(max(h.score), 6) AS found FROM sessions s JOIN history h ON s.session_id = h.session_id GROUP BY s.session_id, s.best_score HAVING abs(s.best_score - max(h.score)) > 0.001e0",
    # scores of names, resources, checks of the record
    "brand_stats": "SELECT split_part(feature_name, '_', 2) AS brand, CAST(count(DISTINCT c.feature_no) AS BIGINT) AS n_features, round(sum(delta * weight) / nullif(sum(weight), 0e0), 6) AS weighted_impact FROM catalog c JOIN impact i ON c.feature_no = i.feature_no GROUP BY split_part(feature_name, '_', 2)",
    "feature_detail": "SELECT feature_no, session_id, CAST(count(*) AS BIGINT) AS n, round(avg(delta), 6) AS avg_impact, round(CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS success FROM impact GROUP BY feature_no, session_id",
    "resource_usage": "SELECT session_id, round(avg(memory_mb), 4) AS avg_mb, round(max(memory_mb), 4) AS max_mb, round(sum(seconds), 4) AS seconds, round(sum(seconds) / nullif(count(*), 0), 6) AS seconds_a_node FROM history GROUP BY session_id",
    "score_per_hour": "SELECT session_id, round(max(score) / nullif(sum(seconds) / 3600e0, 0e0), 4) AS best_per_hour FROM history GROUP BY session_id",
    "explore_ratio": "SELECT session_id, CAST(sum(CASE WHEN visits <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS explored, CAST(sum(CASE WHEN visits > 1 THEN 1 ELSE 0 END) AS BIGINT) AS exploited, round(CAST(sum(CASE WHEN visits <= 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN visits > 1 THEN 1 ELSE 0 END), 0), 6) AS ratio FROM history GROUP BY session_id",
    "timing_percentiles": "WITH r AS (SELECT operation, seconds, row_number() OVER (PARTITION BY operation ORDER BY node_id DESC) AS k FROM history) SELECT operation, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY seconds), 6) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY seconds), 6) AS p90, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY seconds), 6) AS p95 FROM r WHERE k <= 100 GROUP BY operation",
    "active_datasets": "SELECT s.dataset_name, CAST(count(DISTINCT h.session_id) AS BIGINT) AS n_sessions, CAST(count(*) AS BIGINT) AS n_nodes FROM history h JOIN sessions s ON h.session_id = s.session_id WHERE h.ts >= (SELECT max(ts) - INTERVAL '30' DAY FROM history) GROUP BY s.dataset_name",
    "dataset_trend": "SELECT s.dataset_name, CAST(date_trunc('month', h.ts) AS DATE) AS month, CAST(count(DISTINCT h.session_id) AS BIGINT) AS n_sessions, round(max(h.score), 6) AS best FROM history h JOIN sessions s ON h.session_id = s.session_id GROUP BY s.dataset_name, CAST(date_trunc('month', h.ts) AS DATE)",
    "operation_success": "WITH d AS (SELECT operation, score - lag(score) OVER (PARTITION BY session_id ORDER BY node_id) AS g FROM history) SELECT operation, CAST(count(g) AS BIGINT) AS n, round(CAST(sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(g), 0), 6) AS success, round(avg(CASE WHEN g > 0 THEN g END), 6) AS avg_gain FROM d GROUP BY operation",
    "improvement_rate": "WITH b AS (SELECT session_id, node_id, score, max(score) OVER (PARTITION BY session_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM history) SELECT session_id, CAST(sum(CASE WHEN before IS NULL OR score > before THEN 1 ELSE 0 END) AS BIGINT) AS improvements, round(CAST(sum(CASE WHEN before IS NULL OR score > before THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS rate FROM b GROUP BY session_id",
    "health_features": "SELECT iteration, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT json_array_length(features_after)) AS BIGINT) AS counts FROM history GROUP BY iteration HAVING count(*) > 1 AND count(DISTINCT json_array_length(features_after)) <= 1",
    "health_accumulation": "SELECT iteration, CAST(max(json_array_length(features_after)) AS BIGINT) AS most FROM history WHERE iteration <= 5 GROUP BY iteration HAVING max(json_array_length(features_after)) > 30",
    "health_ucb": "SELECT round(CAST(sum(CASE WHEN ucb IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS missing, CAST(sum(CASE WHEN ucb < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(sum(CASE WHEN ucb = CAST('infinity' AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS infinite, round(max(CASE WHEN ucb < CAST('infinity' AS DOUBLE) THEN ucb END), 6) AS most FROM history",
    "health_memory": "SELECT session_id, round(max(memory_mb), 4) AS most_mb, CAST(count(*) AS BIGINT) AS n, max(memory_mb) > 1000 OR count(*) > 10000 AS heavy FROM history GROUP BY session_id",
    "verify_order": "SELECT CAST(sum(CASE WHEN c.parent_id > c.node_id THEN 1 ELSE 0 END) AS BIGINT) AS parent_later, CAST(sum(CASE WHEN c.visits > p.visits THEN 1 ELSE 0 END) AS BIGINT) AS more_visits, CAST(sum(CASE WHEN json_array_length(c.features_after) < json_array_length(p.features_after) THEN 1 ELSE 0 END) AS BIGINT) AS fewer_features FROM history c JOIN history p ON c.parent_id = p.node_id",
    "verify_ids": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT node_id) AS BIGINT) AS n_ids, CAST(max(node_id) - min(node_id) + 1 - count(DISTINCT node_id) AS BIGINT) AS gaps FROM history",
    "verify_sessions": "SELECT s.session_id, CAST(s.total_iterations AS BIGINT) AS recorded, CAST(count(DISTINCT h.iteration) AS BIGINT) AS found, count(DISTINCT h.iteration) > s.total_iterations + 2 AS too_many, avg(h.seconds) > 300 AS slow FROM sessions s LEFT JOIN history h ON s.session_id = h.session_id GROUP BY s.session_id, s.total_iterations",
}


def sql(name: str) -> str:
    """A query with the store's tables it uses in front of it."""
    q = QUERIES[name]
    used = [f"{t} AS ({body})" for t, body in SOURCES.items() if re.search(rf"\b{t}\b", q)]
    own = re.match(r"WITH (RECURSIVE )?", q)
    return f"WITH {own[1] or ''}" + ", ".join([*used, q[own.end() :]]) if own else "WITH " + ", ".join(used) + " " + q


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in ("customer", "orders", "lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql(name))

"""Analytics over a user's own store of recorded searches; every choice is a parameter.

Scale: the store's tables are joined on their keys, small sides broadcast by Spark's own sizes; reports that are limited keep
their best rows in each task before these meet. Means are ordered to nine digits and ties by name or id, so that reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.temporal import series_features
from ..storage import drop_table, large, materialize
from .analytics import SOURCES


@dataclass(frozen=True)
class Store:
    """sessions (session_id, session_name, status, dataset_name, total_iterations, best_score, is_test_mode, start_time, seconds), history (session_id, node_id, parent_id,
    iteration, operation, score, visits, ucb, ts, seconds, memory_mb, features_after as JSON), impact (session_id, feature_no, delta, weight), catalog (feature_no,
    feature_name, category, cost, data_type, is_active)."""

    sessions: DataFrame
    history: DataFrame
    impact: DataFrame
    catalog: DataFrame


def from_sales(spark: SparkSession, sf_dir: str) -> Store:
    """A store derived from the sales tables."""
    for t in ("customer", "orders", "lineitem", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return Store(**{name: spark.sql(body) for name, body in SOURCES.items()})


def _share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def _ranked(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0, rank: str | None = None) -> DataFrame:
    """The rows offset to offset + limit in this order; with a rank, numbered from 1: one task, of the limited rows only."""
    if limit is None:
        return df
    df = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)) + offset) if rank else df


def feature_stats(store: Store) -> DataFrame:
    """(feature_no, feature_name, category, uses, n_sessions, avg_impact, total_impact, best_impact, success_rate) of each feature of the catalog."""
    per = store.impact.groupBy("feature_no").agg(F.count("*").alias("uses"), F.count_distinct("session_id").alias("n_sessions"), F.avg("delta").alias("avg_impact"), F.sum("delta").alias("total_impact"), F.max("delta").alias("best_impact"), _share(F.col("delta") > 0).alias("success_rate"))
    return store.catalog.select("feature_no", "feature_name", "category").join(per, "feature_no", "left").fillna({"uses": 0, "n_sessions": 0})


METRICS = ("avg_impact", "total_impact", "best_impact", "success_rate", "uses", "n_sessions")


def feature_rankings(store: Store, min_sessions: int = 3, metric: str = "avg_impact", limit: int | None = 20) -> DataFrame:
    """The best features by a metric, numbered, of those that enough sessions used."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return _ranked(feature_stats(store).where(F.col("n_sessions") >= min_sessions), [F.desc(F.round(metric, 9)), F.asc("feature_name")], limit, rank="rank")


def list_features(store: Store, category: str | None = None, name_like: str | None = None, least_impact: float | None = None, least_uses: int = 0, order: str = "avg_impact", descending: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Features with their statistics, filtered, ordered (nulls last) and paged."""
    out = feature_stats(store).where(F.col("uses") >= least_uses)
    if category is not None:
        out = out.where(F.col("category") == category)
    if name_like is not None:
        out = out.where(matches(F.col("feature_name"), name_like))
    if least_impact is not None:
        out = out.where(F.col("avg_impact") >= least_impact)
    by = F.desc_nulls_last(order) if descending else F.asc_nulls_last(order)
    return _ranked(out, [by, F.asc("feature_name")], limit, offset)


def matches(c: Column, pattern: str) -> Column:
    """Whether a text fits a pattern, whatever its case: * stands for any text, ? for one character, a pattern without either for a part."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = escaped.replace("*", "%").replace("?", "_") if set(pattern) & set("*?") else f"%{escaped}%"
    return c.ilike(like)


def search_features(store: Store, text: str, fuzzy: float | None = None) -> DataFrame:
    """(feature_no, feature_name, category, relevance): 1 the name itself, 2 the name fits, 3 the category fits, 4 a share of the text's letters is in the name."""
    name, letters = F.col("feature_name"), sorted(set(text.lower()) - set("*? "))
    rank = F.when(F.lower(name) == text.lower(), 1).when(matches(name, text), 2).when(matches(F.col("category"), text), 3)
    if fuzzy is not None and letters:
        share = reduce(lambda a, b: a + b, [F.contains(F.lower(name), F.lit(x)).cast("int") for x in letters]) / len(letters)
        rank = rank.when(share >= fuzzy, 4)
    return store.catalog.select("feature_no", "feature_name", "category", rank.alias("relevance")).where("relevance is not null")


def impact_matrix(store: Store, datasets: list[str], top: int = 10) -> DataFrame:
    """A row for each of the top features by size of impact, with its mean impact on each data set."""
    best = _ranked(feature_stats(store).where("uses > 0").withColumn("size", F.round(F.abs("avg_impact"), 9)), [F.desc("size"), F.asc("feature_name")], top)
    each = store.impact.join(F.broadcast(best.select("feature_no", "feature_name")), "feature_no").join(store.sessions.select("session_id", "dataset_name"), "session_id")
    return each.groupBy("feature_name").pivot("dataset_name", datasets).agg(F.avg("delta"))


def combinations(store: Store, limit: int = 10) -> DataFrame:
    """(feature_no, paired, n_sessions, avg_impact, place): the features of most impact in the sessions that used a feature."""
    used = store.impact.select("session_id", "feature_no").distinct()
    # sums of a session's features meet the features that the session used: rows are pairs within one session
    own = store.impact.groupBy("session_id", F.col("feature_no").alias("paired")).agg(F.sum("delta").alias("s"), F.count("delta").alias("n"))
    pairs = used.join(own, "session_id").where("feature_no <> paired").groupBy("feature_no", "paired").agg(F.count("*").alias("n_sessions"), (F.sum("s") / F.sum("n")).alias("avg_impact"))
    w = Window.partitionBy("feature_no").orderBy(F.desc(F.round("avg_impact", 9)), "paired")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def recommendations(store: Store, session: str, limit: int = 10, top: int = 50, pairs: int = 5, weight: float = 0.5, min_sessions: int = 1) -> DataFrame:
    """Top features that a session has not used: mean impact, and weight times the impact of their best partners that it has used."""
    used = store.impact.where(F.col("session_id") == session).select("feature_no").distinct()
    best = feature_rankings(store, min_sessions, limit=top).join(used, "feature_no", "left_anti")
    synergy = combinations(store, pairs).join(used.withColumnRenamed("feature_no", "paired"), "paired", "left_semi").groupBy("feature_no").agg(F.sum("avg_impact").alias("synergy"))
    out = best.join(synergy, "feature_no", "left").withColumn("synergy", F.coalesce("synergy", F.lit(0.0))).withColumn("recommendation", F.col("avg_impact") + weight * F.col("synergy"))
    return _ranked(out.select("feature_name", "avg_impact", "success_rate", "synergy", "recommendation"), [F.desc(F.round("recommendation", 9)), F.asc("feature_name")], limit)


def feature_trend(store: Store, recent: int = 10) -> DataFrame:
    """(feature_no, recent_avg, older_avg, trend): the last `recent` uses against as many before, by weight and session as their order."""
    w = Window.partitionBy("feature_no").orderBy(F.desc("weight"), F.desc("session_id"), F.desc("delta"))
    each = store.impact.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 2 * recent)
    out = each.groupBy("feature_no").agg(F.avg(F.when(F.col("k") <= recent, F.col("delta"))).alias("recent_avg"), F.avg(F.when(F.col("k") > recent, F.col("delta"))).alias("older_avg"))
    return out.withColumn("trend", F.when(F.col("older_avg").isNull(), "stable").when(F.col("recent_avg") > F.col("older_avg"), "improving").otherwise("declining"))


def catalog_summary(store: Store, top: int = 5) -> DataFrame:
    """(section, name, value): totals, features by category, features in use, and the features used most."""
    stats = feature_stats(store)
    totals = stats.agg(F.count("*").alias("features"), F.count_if(F.col("uses") > 0).alias("used"), F.count_if(F.col("avg_impact") > 0).alias("positive"))
    rows = totals.select(F.lit("totals").alias("section"), F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    by = stats.groupBy("category").agg(F.count("*").cast("double").alias("value")).select(F.lit("category").alias("section"), F.col("category").alias("name"), "value")
    most = _ranked(stats.select(F.lit("most used").alias("section"), F.col("feature_name").alias("name"), F.col("uses").cast("double").alias("value")), [F.desc("value"), F.asc("name")], top)
    return rows.union(by).union(most)


def _of_period(sessions: DataFrame, start: str, end: str) -> DataFrame:
    day = F.to_date("start_time")
    return sessions.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))


def period_metrics(sessions: DataFrame) -> DataFrame:
    """One row of what happened in these sessions."""
    done = F.col("status") == "completed"
    return sessions.agg(
        F.count("*").cast("double").alias("total_sessions"), F.count_if(done).cast("double").alias("completed_sessions"), (F.count_if(done) / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"),
        F.coalesce(F.avg(F.when(done, F.coalesce("best_score", F.lit(0.0)))), F.lit(0.0)).alias("avg_score"), F.coalesce(F.max(F.when(done, F.col("best_score"))), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.sum("total_iterations"), F.lit(0)).cast("double").alias("total_iterations"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_time"),
    )


def compare_periods(store: Store, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """(metric, first, second, absolute, percentage, improved) of two periods of days, both ends included; more is better in rates and scores, less in all else."""
    parts = []
    for name, (a, b) in (("first", first), ("second", second)):
        one = period_metrics(_of_period(store.sessions, a, b))
        parts.append(one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("metric", name)))
    diff = F.col("first") - F.col("second")
    better = F.when(F.col("metric").rlike("rate|score"), diff > 0).otherwise(diff < 0)
    return parts[0].join(parts[1], "metric").withColumns({"absolute": diff, "percentage": F.when(F.col("second") > 0, diff / F.col("second") * 100).otherwise(0.0), "improved": better})


def performance_summary(store: Store, now: str, days: int = 30, dataset: str | None = None) -> DataFrame:
    """One row: sessions of the last days by age and outcome, and how many features help."""
    age = F.datediff(F.lit(now).cast("date"), F.to_date("start_time"))
    recent = store.sessions.where((age >= 0) & (age <= days))
    if dataset is not None:
        recent = recent.where(F.col("dataset_name") == dataset)
    stats = feature_stats(store).where("uses > 0").agg(F.count("*").alias("features"), F.count_if(F.col("avg_impact") > 0).alias("positive_features"), F.avg("avg_impact").alias("avg_impact"), F.max("avg_impact").alias("best_impact"))
    counts = recent.agg(F.count_if(age < 1).alias("sessions_1d"), F.count_if(age < 7).alias("sessions_7d"))
    return period_metrics(recent).crossJoin(counts).crossJoin(stats)  # one row each


def list_sessions(store: Store, status: str | None = None, dataset: str | None = None, least_score: float | None = None, order: str = "best_score", limit: int | None = 10) -> DataFrame:
    """Sessions with what they explored and their score per hour."""
    out = store.sessions
    for c, v in (("status", status), ("dataset_name", dataset)):
        out = out.where(F.col(c) == v) if v is not None else out
    out = out.where(F.col("best_score") >= least_score) if least_score is not None else out
    nodes = store.history.groupBy("session_id").agg(F.count("*").alias("nodes"), F.count_distinct("operation").alias("operations"))
    out = out.join(nodes, "session_id", "left").fillna({"nodes": 0, "operations": 0}).withColumn("score_per_hour", F.try_divide("best_score", F.col("seconds") / 3600))
    return _ranked(out.select("session_id", "status", "dataset_name", "best_score", "total_iterations", "nodes", "operations", "score_per_hour"), [F.desc_nulls_last(order), F.asc("session_id")], limit)


def compare_sessions(store: Store, ids: list[str]) -> DataFrame:
    """Sessions side by side, with the distance of each one's best score to the best of all."""
    out = list_sessions(store, limit=None).where(F.col("session_id").isin(*ids))
    return out.join(out.agg(F.max("best_score").alias("top")), F.lit(True)).withColumn("behind", F.col("top") - F.col("best_score")).drop("top")


def cleanup_candidates(store: Store) -> DataFrame:
    """(session_id, reason, n_history, n_impact) of interrupted sessions, active ones without progress, and tests."""
    why = F.when(F.col("status") == "interrupted", "interrupted").when((F.col("total_iterations") == 0) & (F.col("status") == "active"), "no progress").when(F.col("is_test_mode"), "test")
    out = store.sessions.select("session_id", why.alias("reason")).where("reason is not null")
    for table, name in ((store.history, "n_history"), (store.impact, "n_impact")):
        out = out.join(table.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left").fillna({name: 0})
    return out


def without_sessions(store: Store, gone: DataFrame) -> Store:
    """The store without these sessions (session_id) and all that belongs to them."""
    keys = gone.select("session_id").distinct()
    return replace(store, **{t: getattr(store, t).join(keys, "session_id", "left_anti") for t in ("sessions", "history", "impact")})


def resolve_session(store: Store, text: str) -> str:
    """The one session that a text means: 'latest', an id, the beginning of one (6 characters at least), or a name."""
    if text == "latest":
        row = store.sessions.orderBy(F.desc_nulls_last("start_time"), F.asc("session_id")).select("session_id").first()
        if row is None:
            raise LookupError("no sessions")
        return row[0]
    tests = [F.col("session_id") == text, F.col("session_name") == text]
    if len(text) >= 6:
        tests.insert(1, F.startswith(F.replace("session_id", F.lit("-")), F.lit(text.replace("-", ""))))
    for test in tests:
        found = [r[0] for r in store.sessions.where(test).select("session_id").limit(2).collect()]
        if len(found) == 2:
            raise LookupError(f"several sessions fit: {text}")
        if found:
            return found[0]
    raise LookupError(f"no such session: {text}")


def node_depths(history: DataFrame) -> DataFrame:
    """(node_id, depth) of all nodes below the roots, by doubling: each node's link jumps twice as far in each round, so that a tree of any depth takes few.

    Nodes on a cycle or below one that is missing have no depth.
    """
    links = history.select("node_id", F.when(F.col("parent_id") == F.col("node_id"), None).otherwise(F.col("parent_id")).alias("up")).dropDuplicates(["node_id"])
    now = materialize(links.select("node_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "depths")
    left = None
    while (open_ := now.where("up is not null").count()) and open_ != left:  # a round that settles no node leaves cycles only
        left = open_
        above = now.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = now.where("up is not null").join(large(above), "up")  # a missing node has no row: its descendants drop out
        last, now = now, materialize(now.where("up is null").unionByName(joined.select("node_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))), "depths")
        drop_table(last)
    return large(now.where("up is null").select("node_id", "depth"))


def tree_stats(store: Store) -> DataFrame:
    """(depth, nodes, avg_score, best_score, feature_counts) of each level."""
    return node_depths(store.history).join(store.history, "node_id").groupBy("depth").agg(F.count("*").alias("nodes"), F.avg("score").alias("avg_score"), F.max("score").alias("best_score"), F.count_distinct(F.json_array_length("features_after")).alias("feature_counts"))


def tree_balance(store: Store) -> DataFrame:
    """One row: depth, widest level, mean width, and whether the tree is too deep, wide or narrow."""
    out = tree_stats(store).agg(F.max("depth").alias("depth"), F.max("nodes").alias("most_wide"), F.avg("nodes").alias("avg_width"))
    return out.withColumn("unbalanced", (F.col("depth") > 50) | (F.col("most_wide") > 100) | ((F.col("avg_width") < 2) & (F.col("depth") > 10)))


def path_to(store: Store, node) -> list:
    """The nodes from the root to a node; one small lookup a level."""
    path = []
    while node is not None and node not in path:
        row = store.history.where(F.col("node_id") == node).select("node_id", "parent_id").first()
        if row is None:
            break
        path.append(row[0])
        node = row[1]
    return path[::-1]


def iteration_gaps(store: Store) -> DataFrame:
    """(session_id, after, before, missing): runs of iterations that a session's record lacks."""
    each = store.history.select("session_id", "iteration").distinct()
    steps = series_features(each.withColumn("before", F.col("iteration")), "iteration", ["before"], ["session_id"], (1,), ())
    return steps.select("session_id", F.col("iteration_lag_1").alias("after"), "before").where("before > after + 1").withColumn("missing", F.col("before") - F.col("after") - 1)


def feature_success(store: Store) -> DataFrame:
    """(feature, uses, successes, gain): what the score gained over the node before, for each feature in use then."""
    steps = series_features(store.history.select("session_id", "iteration", "node_id", "features_after", "score"), "score", ["iteration", "node_id"], ["session_id"], (1,), ())
    each = steps.select("features_after", (F.col("score") - F.col("score_lag_1")).alias("gain")).where("gain is not null and features_after is not null")
    return each.select("gain", F.explode(F.from_json("features_after", "array<string>")).alias("feature")).groupBy("feature").agg(F.count("*").alias("uses"), F.count_if(F.col("gain") > 0).alias("successes"), F.sum("gain").alias("gain"))


def feature_mode(store: Store) -> DataFrame:
    """One row: operations, features an operation, and whether each feature is its own operation (over 50 of them, 1.5 features each at most)."""
    per = store.catalog.groupBy(F.col("category").alias("operation")).agg(F.count("*").alias("n"))
    out = per.agg(F.count_distinct("operation").alias("operations"), F.count("*").alias("total"), F.avg("n").alias("avg_features"))
    return out.withColumn("single", (F.col("operations") > 50) & (F.col("avg_features") <= 1.5) & (F.col("operations") / F.col("total") > 0.8))


def timing(store: Store, last: int = 100, change: float = 0.1) -> DataFrame:
    """(operation, n, total, least, most, p50, p90, p95, trend, stability): times of all nodes, percentiles and trend of the last ones."""
    w = Window.partitionBy("operation").orderBy(F.desc("node_id"))
    recent = store.history.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)  # Spark keeps `last` rows an operation and task
    n = F.count("*").over(Window.partitionBy("operation"))
    recent = recent.withColumn("old", F.col("k") > n - F.floor(n / 2))
    per = recent.groupBy("operation").agg(F.percentile("seconds", 0.5).alias("p50"), F.percentile("seconds", 0.9).alias("p90"), F.percentile("seconds", 0.95).alias("p95"), F.avg(F.when(F.col("old"), F.col("seconds"))).alias("a"), F.avg(F.when(~F.col("old"), F.col("seconds"))).alias("b"), F.count("*").alias("m"), F.try_divide(F.max("seconds"), F.min("seconds")).alias("stability"))
    rise = F.try_divide(F.col("b") - F.col("a"), "a")
    trend = F.when(F.col("m") < 10, "stable").when(rise > change, "increasing").when(rise < -change, "decreasing").otherwise("stable")
    whole = store.history.groupBy("operation").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    return whole.join(per.select("operation", "p50", "p90", "p95", trend.alias("trend"), "stability"), "operation")


def health_exploration(store: Store, after: int = 10, last: int = 10) -> DataFrame:
    """(session_id, avg_nodes, most_visits, avg_spread, issues) over the last iterations after the first ones."""
    per = store.history.where(F.col("iteration") > after).groupBy("session_id", "iteration").agg(F.count_distinct("node_id").alias("nodes"), F.max("visits").alias("most"), F.stddev_samp("visits").alias("spread"))
    per = per.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("iteration")))).where(F.col("k") <= last)
    out = per.groupBy("session_id").agg(F.avg("nodes").alias("avg_nodes"), F.max("most").alias("most_visits"), F.avg("spread").alias("avg_spread"))
    issues = F.array_compact(F.array(F.when(F.col("avg_nodes") < 2, F.lit("few nodes")), F.when(F.col("most_visits") > 50, F.lit("visits in one place")), F.when(F.col("avg_spread") < 1, F.lit("little variance"))))
    return out.withColumn("issues", F.array_join(issues, ";"))


def health_traps(store: Store, score: float = 0.7, visits: int = 3, children: int = 2, drop: float = 0.8) -> DataFrame:
    """(node_id, n_children): well-visited nodes of a high score whose children do much worse."""
    own = store.history.where((F.col("score") > score) & (F.col("visits") > visits)).select("node_id", F.col("score").alias("own"))
    kids = store.history.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"), F.avg("score").alias("mean"))
    return own.join(kids, "node_id").where((F.col("n_children") >= children) & (F.col("mean") < drop * F.col("own"))).select("node_id", "n_children")


def health_memory(store: Store, most_mb: float = 1000, growth: float = 2, nodes: int = 10_000) -> DataFrame:
    """(session_id, most_mb, growth, n_nodes, issues): memory of the later half of the iterations over that of the first half."""
    per = store.history.groupBy("session_id", "iteration").agg(F.count("*").alias("n"), F.avg("memory_mb").alias("mean"), F.max("memory_mb").alias("most"))
    w = Window.partitionBy("session_id")
    has = per.withColumn("m", F.count("mean").over(w)).withColumn("k", F.when(F.col("mean").isNotNull(), F.count("mean").over(w.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0))))
    late = F.col("k") > F.floor(F.col("m") / 2)
    ratio = F.when(F.max("m") > 10, F.try_divide(F.avg(F.when(late, F.col("mean"))), F.avg(F.when(~late, F.col("mean"))))).otherwise(1.0)
    out = has.groupBy("session_id").agg(F.max("most").alias("most_mb"), F.coalesce(ratio, F.lit(1.0)).alias("growth"), F.sum("n").alias("n_nodes"))
    issues = F.array_compact(F.array(F.when(F.col("most_mb") > most_mb, F.lit("much memory")), F.when(F.col("growth") > growth, F.lit("growing memory")), F.when(F.col("n_nodes") > nodes, F.lit("large tree"))))
    return out.withColumn("issues", F.array_join(issues, ";"))


def health_exists(store: Store, session: str) -> bool:
    return not store.history.where(F.col("session_id") == session).isEmpty()


def health_ucb(store: Store) -> DataFrame:
    """One row: what is wrong with the recorded bounds: over a tenth missing, negative ones, none infinite among over ten, finite ones above ten."""
    x = F.col("ucb")
    row = store.history.agg(F.count("*").alias("n"), F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)).alias("missing"), F.count_if(x < 0).alias("negative"), F.count_if(x == float("inf")).alias("infinite"), F.max(F.when(x < float("inf"), x)).alias("most"))
    tests = {"missing": F.col("missing") > 0.1, "negative": F.col("negative") > 0, "none infinite": (F.col("infinite") == 0) & (F.col("n") > 10), "too large": F.col("most") > 10}
    return row.withColumn("issues", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])), ";"))

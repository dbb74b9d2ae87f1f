"""Exact nearest vectors by integer inner product: tiles of queries and shards are multiplied, each tile's best are kept.

Scale: queries are dealt into rounds by a hash, so that a round's vectors fit in a broadcast of ROUND_MB; each round passes once
over the table of vectors, without a shuffle of it. A task multiplies tiles, keeps its best K of each query and hands over these
only; the lists are merged in a tree of FAN lists a node, so no task gathers what grows with the number of tasks. A vector that
occurs very often is dealt over tiles like any others. Products use floats or doubles where these are exact, and else whole numbers of any size.

Edge cases: vectors that are null, or hold a null or a component that isn't finite (also after scaling), take no part; only
vectors of equal length are compared, and those without components have score 0. Each row that has a query's id is a query of its
own and meets all rows but itself, repeated rows included; a row without an id is no query, but is found, after all ids of
the same score. Scores beyond 64 bits are returned as the nearest such number. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, ship

K, FAN, SCALE = 5, 32, 256
ROUND_MB = 64
TILE_QUERIES, TILE_ROWS = 1024, 4096
MOST, NONE = 2**63 - 1, -(2**63)  # the largest score, and no score


def taking_part(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(row, id, size, v) of the vectors that take part; row tells rows apart."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & (F.abs(x.cast("double") * scale) < float("inf")))
    kept = vectors.where(F.col(vec_col).isNotNull() & whole)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("size"), F.col(vec_col).alias("v"))


def _by_length(batch: pa.RecordBatch, scale: int):
    """(rows, ids, which lack an id, whole components as doubles) of a batch's vectors, for each length."""
    row, ids, size, vec = (batch.column(i) for i in range(4))
    size, start = size.to_numpy(), np.asarray(vec.offsets)[:-1]
    flat = np.asarray(vec.values.cast(pa.float64()))
    row, lacks, ids = row.to_numpy(), np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), row[at], ids[at], lacks[at], np.floor(scale * flat[start[at][:, None] + np.arange(n)])


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held in doubles, exactly, but for those beyond 64 bits, which are clipped."""
    n = queries.shape[1]
    most = float(np.abs(queries).max()) * float(np.abs(rows).max()) * n if n else 0.0
    if most < 2**24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array([[int(x) for x in r] for r in rows], dtype=object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def best_of_tile(scores: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, in no order, and their scores: higher ones first, then earlier columns. own: places that don't count."""
    wide = scores.shape[1]
    most = max(int(scores.max()), -int(scores.min()))
    if (most + 2) * wide < 2**62:
        scores[own] = -most - 1
        rank = scores * wide + np.arange(wide - 1, -1, -1)
        cols = np.argpartition(rank, wide - k, axis=1)[:, wide - k :] if wide > k else np.broadcast_to(np.arange(wide), scores.shape)
        found = np.take_along_axis(scores, cols, 1)
        return cols, np.where(found == -most - 1, NONE, found)
    scores[own] = NONE
    cols = np.argsort(~scores, axis=1, kind="stable")[:, :k]
    return cols, np.take_along_axis(scores, cols, 1)


class TopLists:
    """The best k rows seen so far for each query."""

    def __init__(self, queries: dict[str, np.ndarray], k: int):
        self.row, self.v, self.k = queries["row"], queries["v"], k
        shape = (len(self.row), k)
        self.score, self.id, self.lacks = np.full(shape, NONE), np.full(shape, MOST), np.ones(shape, bool)

    def add(self, row, ids, lacks, v) -> None:
        order = np.lexsort((ids, lacks))
        row, ids, lacks, v = row[order], ids[order], lacks[order], v[order]
        for q0 in range(0, len(self.row), TILE_QUERIES):
            for r0 in range(0, len(row), TILE_ROWS):
                self._tile(slice(q0, q0 + TILE_QUERIES), row[r0 : r0 + TILE_ROWS], ids[r0 : r0 + TILE_ROWS], lacks[r0 : r0 + TILE_ROWS], v[r0 : r0 + TILE_ROWS])

    def _tile(self, q: slice, row, ids, lacks, v) -> None:
        scores = products(self.v[q], v)
        hit = np.flatnonzero(scores.max(axis=1) >= self.score[q, -1])  # other queries have k better ones
        if not len(hit):
            return
        at = hit + q.start
        own = np.intersect1d(self.row[at], row, assume_unique=True, return_indices=True)[1:]
        cols, found = best_of_tile(scores[hit], own, self.k)
        score, id_, lack = np.hstack([self.score[at], found]), np.hstack([self.id[at], ids[cols]]), np.hstack([self.lacks[at], lacks[cols]])
        first = np.lexsort((id_, lack, ~score), axis=-1)[:, : self.k]
        self.score[at], self.id[at], self.lacks[at] = (np.take_along_axis(x, first, 1) for x in (score, id_, lack))


LIST = "array<struct<neg: bigint, no_id: boolean, id: bigint>>"


def _lists(vectors: DataFrame, queries, k: int, scale: int) -> DataFrame:
    """(query, part, best): a list of each task's best rows for each query; queries: a broadcast."""

    def run(batches):
        own = {n: TopLists(q, k) for n, q in queries.value.items()}
        for b in batches:
            for n, *rest in _by_length(b, scale):
                if n in own:
                    own[n].add(*rest)
        part = TaskContext.get().partitionId()
        for q in own.values():
            for i in range(0, len(q.row), 10_000):
                s = slice(i, i + 10_000)
                has = q.score[s] != NONE
                entries = pa.StructArray.from_arrays([pa.array(-q.score[s][has]), pa.array(q.lacks[s][has]), pa.array(q.id[s][has], mask=q.lacks[s][has])], names=["neg", "no_id", "id"])
                best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([pa.array(q.row[s]), pa.array(np.full(len(best), part), pa.int64()), best], names=["query", "part", "best"])

    return vectors.select("row", "id", "size", "v").mapInArrow(run, f"query bigint, part bigint, best {LIST}")


def search(vectors: DataFrame, id_col: str, vec_col: str, every: int = 50, k: int = K, scale: int = SCALE, round_mb: int = ROUND_MB) -> DataFrame:
    """(query_id, rank, id, score): the k rows of highest score for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    ship(spark)
    table = materialize(taking_part(vectors, id_col, vec_col, scale), "vectors")
    asked = table.where(F.col("id") % every == 0)
    need = asked.agg(F.sum((F.col("size") + 8).cast("long") * 8)).first()[0] or 0
    rounds, tasks, out = max(1, math.ceil(need / (round_mb * 10**6))), table.rdd.getNumPartitions(), None
    for r in range(rounds):
        got: dict[int, list] = {}
        for b in asked.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).toArrow().to_batches():  # a round's, of bounded size
            for n, row, _, _, v in _by_length(b, scale):
                got.setdefault(n, []).append((row, v))
        sent = spark.sparkContext.broadcast({n: {"row": np.concatenate([x[0] for x in xs]), "v": np.concatenate([x[1] for x in xs])} for n, xs in got.items()})
        lists, width = _lists(table, sent, k, scale), tasks
        while width > 1:
            width = math.ceil(width / FAN)
            lists = lists.groupBy("query", F.floor(F.col("part") / FAN).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        done = materialize(lists.select("query", "best"), "top-lists")
        sent.destroy()
        out = done if out is None else out.unionByName(done)
    named = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id")).join(out, "query")
    return named.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.neg")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.vec_id AS query_id, a.r AS query, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 5
"""

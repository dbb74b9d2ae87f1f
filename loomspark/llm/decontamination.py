"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; k consecutive words are hashed, and in every stretch of w hashes the least is kept. A shared
span of k + w - 1 words has equal stretches on both sides, so its least hash is kept on both and meets in the join:
with span 13 (k = 5, w = 9) no shared window of 13 words is lost. Items of fewer words are one window of their own
length L and are winnowed with k + w - 1 = L, for each L that the benchmark holds.

A kept hash stands for the run of windows that share it, w of them at most: where the least hash comes again within
w places, as in periodic text, a longer run is cut into runs of w windows. Runs whose hash the benchmark has too are
extended to their windows, and a window counts if its words equal a benchmark window's exactly.

Scale: the first pass over the documents hashes them and keeps the places of runs that meet a benchmark hash; the
second cuts words, of the documents that have such places only. Texts are not shuffled where the candidates are few, and
else only those of candidates. The benchmark's hashes and windows are broadcast when rows and bytes are counted to be few,
and joined by a shuffle beyond.

Edge cases: null texts have no words; an item without words has no window; find_overlaps() knows a document by doc_id and text,
so rows repeated in full give one row; per_document() and the query give a row for each of them; an empty benchmark leaves all documents clean. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, read_table, words_of

SPAN = 13
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 32_000_000


def _gram(span: int) -> tuple[int, int]:
    """Words in a hash and hashes in a stretch, for windows of span words."""
    k = max(1, span * 5 // SPAN)
    return k, span - k + 1


def _least(values: Column, w: int, body):
    """body(the least of each w values in a row), by doubling the width; the last w - 1 entries are of fewer values."""

    def grow(m: Column, width: int) -> Column:
        if width == w:
            return body(m)
        jump = min(width, w - width)
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + jump))), lambda wider: grow(wider, width + jump))

    return let(values, lambda m: grow(m, 1))


def winnow(hashes: Column, span: int) -> Column:
    """Runs of at most w windows that share their least hash, of a text given by its words' hashes: array of struct(span, s, h); s is the first window."""
    k, w = _gram(span)
    n_windows = F.size(hashes) - span + 1

    def runs(m: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), n_windows - 1), lambda s: (s == 0) | (F.get(m, s) != F.get(m, s - 1)))
        starts = let(firsts, lambda fs: F.flatten(F.transform(fs, lambda a, j: F.sequence(a, F.coalesce(F.get(fs, j + 1), n_windows) - 1, F.lit(w)))))
        return F.transform(starts, lambda s: F.struct(F.lit(span).alias("span"), s.alias("s"), F.get(m, s).alias("h")))

    grams = F.transform(F.slice(hashes, 1, n_windows + w - 1), lambda x, i: F.xxhash64(F.lit(span), x, *[F.get(hashes, i + j) for j in range(1, k)]))
    return F.when(n_windows > 0, _least(grams, w, runs)).otherwise(F.array().cast("array<struct<span:int,s:int,h:bigint>>"))


def few(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if its rows and their bytes are counted to be few."""
    n, size = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if n <= limit and (size or 0) <= MAX_BROADCAST_BYTES else df


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def winnow_words(words: Column, span: int) -> Column:
    return let(_hashes(words), lambda h: winnow(h, span))


def find_overlaps(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", span: int = SPAN, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, text_hash, n_words, n_hit, items): items has the ids of benchmark items with a window in the document."""
    items = (
        bench.select(F.col(item_col).alias("item"), words_of(ascii_lower(F.col(item_text))).alias("ws"))
        .where(F.size("ws") > 0)
        .withColumn("span", F.least(F.lit(span), F.size("ws")))
    )
    windows = materialize(items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("span") + 1), lambda i: F.array_join(F.slice("ws", i, F.col("span")), " "))).alias("win")).distinct(), "windows")
    spans = sorted(r[0] for r in items.select("span").distinct().collect())  # 13 values at most
    hashes = docs.sparkSession.range(0).select(F.col("id").alias("bench_h"))
    for n in spans:
        hashes = hashes.union(items.where(F.col("span") == n).select(F.explode(winnow_words(F.col("ws"), n)).alias("r")).select(F.col("r.h")))
    hashes = materialize(hashes.distinct(), "winnowed")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    ws = words_of(ascii_lower(F.col("text")))
    head = lambda h: F.struct(F.lit(0).alias("span"), (-1 - F.size(h)).alias("s"), F.lit(0).cast("long").alias("h"))  # noqa: E731  one for each document
    runs = let(_hashes(ws), lambda h: F.concat(F.array(head(h)), *[winnow(h, n) for n in spans]))
    met = (
        texts.select("id", "text_hash", F.explode(runs).alias("r")).select("id", "text_hash", "r.*")
        .join(few(hashes, max_broadcast_rows), F.col("h") == F.col("bench_h"), "left")
        .where("s < 0 or bench_h is not null")
        .groupBy("id", "text_hash")
        .agg(F.max(F.when(F.col("s") < 0, -1 - F.col("s"))).cast("long").alias("n_words"), F.collect_set(F.when(F.col("s") >= 0, F.struct("span", "s"))).alias("runs"))
    )
    met = materialize(met, "runs")

    found = few(met.where(F.size("runs") > 0).select(F.col("id").alias("own_id"), F.col("text_hash").alias("own_hash"), "runs"), max_broadcast_rows)
    near = texts.join(found, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    widths = F.create_map(*[F.lit(x) for n in spans or [1] for x in (n, _gram(n)[1])])
    at = lambda w: F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["s"], F.least(r["s"] + widths[r["span"]], F.size(w) - r["span"] + 1) - 1), lambda i: F.struct(r["span"].alias("span"), i.alias("at"), F.array_join(F.slice(w, i + 1, r["span"]), " ").alias("win")))))
    hits = (
        near.select("id", "text_hash", F.explode(let(ws, at)).alias("w")).select("id", "text_hash", "w.*")
        .join(few(windows, max_broadcast_rows), "win")
        .groupBy("id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("at", "span"))).alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc, p):
        end = p["at"] + p["span"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(p["at"], acc["end"]))).cast("long").alias("n"))

    per_hit = hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.aggregate("places", start, cover, lambda acc: acc["n"]).alias("hit"), F.col("items").alias("found"))
    per_hit = few(materialize(per_hit, "hits"), max_broadcast_rows)
    out = met.join(per_hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    kind = dict(items.dtypes)["item"]
    return out.select(F.col("id").alias(id_col), "text_hash", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("found", F.array().cast(f"array<{kind}>")).alias("items"))


def per_document(found: DataFrame, docs: DataFrame, id_col="doc_id", text_col="text", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """find_overlaps()'s rows, each as often as the documents have its id and text; only what is repeated is joined."""
    copies = docs.groupBy(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash")).agg(F.count("*").alias("copies")).where("copies > 1")
    copies = few(materialize(copies, "copies"), max_broadcast_rows)
    n = F.coalesce("copies", F.lit(1))
    block = 10_000  # numbers in one array, so that any number of copies is dealt out in bounded ones
    out = found.join(copies, F.col(id_col).eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
    out = out.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / block))))
    return out.withColumn("c", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), n - F.col("b") * block)))).select(*found.columns)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: any hit, and a twentieth of the words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = per_document(find_overlaps(docs, read_table(spark, sf_dir, "benchmark")), docs)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


#: Every window of every document against every item window; DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b0 AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
b AS (SELECT item_id, ws, least(13, len(ws)) AS span FROM b0 WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, span, array_to_string(ws[i : i + span - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - span + 2)) AS i FROM b)),
dw AS (SELECT doc_id, span, i, array_to_string(ws[i : i + span - 1], ' ') AS win FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM b) WHERE len(ws) >= span)),
hit AS (SELECT doc_id, dw.span, i, item_id FROM dw JOIN bw USING (win, span)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + span)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

"""Search over names, ids, paths and descriptions with weighted scores, through an inverted index of short runs of letters.

A text that contains a query contains its rarest run of three letters, and a name that has most of a query's letters has one of its rarest; these
give candidates, which are then tested on the texts themselves. Many queries are answered at once. Each different text is indexed and tested once,
however many keys have it; matches are then handed to its keys. Runs of letters that most texts have are no hot tasks: the smaller side is sent to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from ..storage import large, materialize

#: What each kind of match adds to a score.
WEIGHTS = {"exact name": 100, "name": 50, "similar name": 25, "id": 75, "path": 30, "description": 20, "competition": 40}
ROLES = ("name", "id", "path", "description", "competition")
SIMILAR = 0.6
#: Rows of queries, or of matches of shared texts, that are sent to all tasks at most; more are joined by shuffles.
MAX_BROADCAST_ROWS = 100_000


def grams(text: Column, n: int) -> Column:
    """The different runs of n letters of a text."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    """owners: (key, role, text), lower-case; texts: (n, role, text, uses, key, letters) of each different one, with one of its keys and the letters of names; grams: (gram, role, n); sizes: (gram, n_texts)."""

    owners: DataFrame
    texts: DataFrame
    grams: DataFrame
    sizes: DataFrame


def build(df: DataFrame, key: str, roles: dict[str, list[str]]) -> Index:
    """roles: for each of ROLES the columns that hold such texts; nulls and empty texts are none."""
    if unknown := set(roles) - set(ROLES):
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    cols = [F.struct(F.lit(r).alias("role"), F.lower(F.col(c).cast("string")).alias("text")) for r, cs in roles.items() for c in cs]
    owners = spread(df).select(F.col(key).alias("key"), F.explode(F.array(*cols)).alias("x")).select("key", "x.role", "x.text").where("text <> ''")
    owners = materialize(owners, "owners")
    texts = owners.groupBy("role", "text").agg(F.count("*").alias("uses"), F.min("key").alias("key"))
    texts = materialize(texts.withColumns({"letters": F.when(F.col("role") == "name", grams(F.col("text"), 1)), "n": F.monotonically_increasing_id()}), "texts")
    each = texts.select("role", "n", F.explode(F.concat(*[grams(F.col("text"), n) for n in (1, 2, 3)])).alias("gram"))
    each = materialize(each.select("gram", "role", "n"), "grams")
    return Index(owners, texts, each, materialize(each.groupBy("gram").agg(F.count("*").alias("n_texts")), "gram-sizes"))


def _sent(df: DataFrame) -> DataFrame:
    """A table for a join with a large one: sent to all tasks if its rows are few, else joined by shuffles."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else large(df)


def _with_sizes(index: Index, each: DataFrame) -> DataFrame:
    """(query, gram) with the number of texts that have the run of letters."""
    wanted = index.sizes.join(_sent(each.select("gram").distinct()), "gram")
    return each.join(wanted, "gram", "left").fillna({"n_texts": 0})


def _candidates(index: Index, queries: DataFrame, similar: float) -> DataFrame:
    """(query, n) that may match."""
    longest = F.when(F.length("query") >= 3, grams(F.col("query"), 3)).when(F.length("query") == 2, grams(F.col("query"), 2)).otherwise(grams(F.col("query"), 1))
    each = _with_sizes(index, queries.select("query", F.explode(longest).alias("gram")))
    rarest = each.groupBy("query").agg(F.min(F.struct("n_texts", "gram"))["gram"].alias("gram"))  # one that no text has finds none
    holds = index.grams.join(_sent(materialize(rarest, "rarest")), "gram").select("query", "n")
    names = index.grams.where("role = 'name' and length(gram) = 1")
    letters = _with_sizes(index, queries.select("query", F.explode(grams(F.col("query"), 1)).alias("gram")))
    w = Window.partitionBy("query")  # a query's letters
    probes = letters.withColumns({"k": F.count("*").over(w), "at": F.row_number().over(w.orderBy("n_texts", "gram"))}).where(F.col("at") <= F.col("k") - F.ceil(F.col("k") * similar - 1e-9) + 1)
    return holds.unionByName(names.join(_sent(materialize(probes.select("query", "gram"), "probes")), "gram").select("query", "n")).distinct()


def search(index: Index, queries: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(query, key, score, reasons) of every match; queries has a column `query`. The name counts once, as the best kind of match that it is."""
    asked = materialize(queries.select(F.lower("query").alias("query")).where("query <> ''").distinct(), "asked")
    pairs = large(_candidates(index, asked, similar)).join(index.texts, "n").join(_sent(asked.withColumn("own", grams(F.col("query"), 1))), "query")
    has, name = F.contains("text", F.col("query")), F.col("role") == "name"
    share = F.size(F.array_intersect("own", "letters")) / F.size("own")
    kind = F.when(name & (F.col("text") == F.col("query")), "exact name").when(name & has, "name").when(name & (share >= similar - 1e-9), "similar name").when(~name & has, F.col("role"))
    bit = F.coalesce(*[F.when(kind == k, 1 << i) for i, k in enumerate(WEIGHTS)])
    hits = materialize(pairs.select("query", "role", "text", "uses", "key", bit.alias("bit")).where("bit is not null"), "hits")
    shared = hits.where("uses > 1").select("query", "role", "text", "bit")
    found = hits.where("uses = 1").select("query", "key", "bit").unionByName(index.owners.join(_sent(shared), ["role", "text"]).select("query", "key", "bit"))
    # a key seldom matches a query twice, so rows are not summed up before they are dealt
    kinds = {k: F.col("bits").bitwiseAND(F.lit(1 << i)) > 0 for i, k in enumerate(WEIGHTS)}
    score = sum((F.when(kinds[k], v).otherwise(0) for k, v in WEIGHTS.items()), F.lit(0)).cast("long")
    reasons = F.concat_ws(", ", *[F.when(kinds[k], k) for k in sorted(WEIGHTS)])
    return found.repartition("query", "key").groupBy("query", "key").agg(F.bit_or("bit").alias("bits")).select("query", "key", score.alias("score"), reasons.alias("reasons"))

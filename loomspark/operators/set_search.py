"""Each set's most similar other set by Jaccard similarity, exactly, for any number of sets.

Equal sets are one. The others are sought at falling similarities: at each, two sets that similar share one of their rarest
features, as many as their sizes leave to differ in, and don't differ too much in size; only such pairs are compared. What has found a partner
that similar takes no further part. In the end features of many sets are left out of the search for pairs: sets that share
nothing else are told apart by which of these they have and by their sizes, and each such class meets two members of each; its two best are
handed to its sets. Cost grows with pairs of classes: many frequent features that occur in all mixtures make as many classes as sets, and nothing exact is far below all pairs then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import large, materialize
from .groups import MAX_BROADCAST_GROUPS

STEPS = ((8, 10), (6, 10), (4, 10))
FREQUENT = 1000


def _names(features: Column) -> Column:
    """A row for each feature."""
    return F.explode(F.transform(features, lambda x: x["f"])).alias("f")


def _rarest_first(sets: DataFrame) -> DataFrame:
    """(set, n, fs): the features of each set, rare ones first."""
    each = sets.select("set", F.explode("fs").alias("f"))
    uses = each.groupBy("f").agg(F.count("*").alias("uses"))
    return each.join(uses, "f").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("uses", "f"))).alias("fs")).withColumn("n", F.size("fs"))


def similar_pairs(active: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that may have a similarity of num / den at least: a of active, b of sets, both (set, n, fs) with rare features first."""
    def head(df: DataFrame, name: str) -> DataFrame:
        room = F.col("n") - F.ceil(F.col("n") * num / den) + 1
        names = F.transform(F.slice("fs", 1, room.cast("int")), lambda x: x["f"])
        return df.select(F.col("set").alias(name), F.col("n").alias(f"n_{name}"), F.posexplode(names).alias(f"at_{name}", "f"))

    near = (F.col("n_b") * den >= F.col("n_a") * num) & (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("a") != F.col("b"))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # that a pair shares whose first shared feature this is
    return head(active, "a").join(head(sets, "b"), "f").where(near & (most * (num + den) >= num * (F.col("n_a") + F.col("n_b")))).select("a", "b").distinct()


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, total) of pairs that share a feature."""
    names = sets.select("set", F.transform("fs", lambda x: x["f"]).alias("names"))
    both = pairs.join(names.withColumnsRenamed({"set": "a", "names": "x"}), "a").join(names.withColumnsRenamed({"set": "b", "names": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total")).where("shared > 0")


def _best(found: DataFrame) -> DataFrame:
    """The most similar b of each a, the least one of equals."""
    return found.groupBy("a").agg(F.min(F.struct((-F.col("shared") / F.col("total")).alias("j"), "b", "shared", "total")).alias("m")).select("a", "m.b", "m.shared", "m.total")


def _two_first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """Each group's two first rows; Spark keeps two rows a group and task."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("k <= 2").drop("k")


def _by_frequent(active: DataFrame, sets: DataFrame, frequent: int) -> DataFrame:
    """(a, b, shared, total) with shared counted over frequent features only: the two best b of each a's class, of the two least sets of each class of sets alike in these and in size."""
    alike = lambda df: df.select("set", "n", F.filter("fs", lambda x: x["uses"] > frequent).alias("own")).where(F.size("own") > 0)
    classes = _two_first(alike(sets), ["own", "n"], "set")
    b = classes.select(F.col("set").alias("b"), F.col("n").alias("n_b"), _names(F.col("own")))
    a = alike(active).select("own", "n").distinct().select("own", "n", _names(F.col("own")))
    shared = a.join(b, "f").groupBy("own", "n", "b", "n_b").agg(F.count("*").cast("int").alias("shared"))
    best = _two_first(shared.withColumn("total", F.col("n") + F.col("n_b") - F.col("shared")), ["own", "n"], -F.col("shared") / F.col("total"), "b")
    best = materialize(best.select("own", "n", "b", "shared", "total"), "best-of-classes")
    best = F.broadcast(best) if best.count() <= MAX_BROADCAST_GROUPS else large(best)
    return alike(active).join(best, ["own", "n"]).where("set <> b").select(F.col("set").alias("a"), "b", "shared", "total")


def most_similar(sets: DataFrame, frequent: int = FREQUENT, steps=STEPS) -> DataFrame:
    """(a, b, jaccard) for each of different sets (set, fs) that shares a feature with another: the most similar one, ties to the least."""
    ranked = materialize(_rarest_first(sets), "ranked-sets")
    active, done = ranked, []
    for num, den in steps:
        best = materialize(_best(_compared(similar_pairs(active, ranked, num, den), ranked).where(F.col("shared") * den >= F.col("total") * num)), "similar-sets")
        done.append(best)
        active = active.join(best.select(F.col("a").alias("set")), "set", "left_anti")
    active = materialize(active, "single-sets")
    rare = lambda df, name: df.select(F.col("set").alias(name), _names(F.filter("fs", lambda x: x["uses"] <= frequent)))
    pairs = rare(active, "a").join(rare(ranked, "b"), "f").where("a <> b").select("a", "b").distinct()
    done.append(_best(_compared(pairs, ranked).unionByName(_by_frequent(active, ranked, frequent))))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # a class's member that shares more than frequent features is more similar than it was counted, but then it was compared as a pair, too, and won
    return out.select("a", "b", (F.col("shared") / F.col("total")).alias("jaccard"))

"""Trees of recorded nodes: depths, subtree sums, places in preorder, paths and drawings, for trees of any depth and width.

Links that jump 1, 2, 4, ... levels up are stored; with them sums over subtrees and over paths take a join a link table, so a few rounds even for
deep trees. A node's place and the size of its subtree are an interval: what is below a node has its place in it. Children in order are summed by
series in pieces, so a node of very many children is no hot task. Nodes on a cycle, or below one that is missing, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import running
from ..storage import large, materialize
from .store import node_depths


def _links(nodes: DataFrame, node: str, parent: str) -> tuple[DataFrame, list[DataFrame]]:
    """(node, parent, depth) of each node of the tree, and (node, up) of links of 1, 2, 4, ... levels."""
    own = nodes.select(F.col(node).alias("node_id"), F.when(F.col(parent) != F.col(node), F.col(parent)).alias("parent_id")).dropDuplicates(["node_id"])
    tree = materialize(own.join(node_depths(own), "node_id").toDF("node", "parent", "depth"), "tree")
    jumps = [materialize(tree.where("parent is not null").select("node", F.col("parent").alias("up")), "links")]
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    while 2 ** len(jumps) <= deepest:
        last = jumps[-1]
        jumps.append(materialize(last.join(large(last.select(F.col("node").alias("up"), F.col("up").alias("next"))), "up").select("node", F.col("next").alias("up")), "links"))
    return tree, jumps


def intervals(nodes: DataFrame, values: dict[str, tuple[str, Column]] | None = None, order: Column | None = None, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node_id, parent_id, depth, place, size, values...): place in preorder from 0, nodes in the subtree, and its sums, least or greatest values.

    values: by name "sum", "min" or "max" and a column of nodes. order: a column that puts children in order, then their ids do.
    """
    tree, jumps = _links(nodes, node, parent)
    how = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}
    kinds = {"size": "sum"} | {n: kind for n, (kind, _) in (values or {}).items()}
    first = nodes.dropDuplicates([node]).select(F.col(node).alias("node"), F.lit(1).cast("long").alias("size"), *[c.alias(n) for n, (_, c) in (values or {}).items()], (order if order is not None else F.lit(0)).alias("_order"))
    below = tree.join(large(first), "node")
    for jump in jumps:
        more = jump.join(large(below), "node").groupBy("up").agg(*[how[k][0](n).alias(f"_{n}") for n, k in kinds.items()])
        joined = below.join(large(more), F.col("node") == F.col("up"), "left")
        below = materialize(joined.withColumns({n: how[k][1](F.col(n), F.col(f"_{n}")) for n, k in kinds.items()}).drop("up", *[f"_{n}" for n in kinds]), "subtrees")
    siblings = running(below, ["parent"], ["_order", "node"], {"_upto": F.col("size")})
    place = siblings.select("node", (F.col("_upto") - F.col("size") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("place"))
    for jump in jumps:
        place = materialize(place, "places")
        above = place.select(F.col("node").alias("up"), F.col("place").alias("more"))
        place = place.join(large(jump.join(large(above), "up").select("node", "more")), "node", "left").select("node", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
    out = below.join(large(place), "node")
    return out.select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "depth", "place", *kinds)


def paths(nodes: DataFrame, targets: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(target, step, node_id): the nodes from the root (step 0) to each target; targets has a column `target`."""
    tree, jumps = _links(nodes, node, parent)
    way = targets.select("target").distinct().select("target", F.col("target").alias("node"))
    for jump in jumps[::-1]:  # each link doubles what is known of a path
        way = materialize(way.unionByName(way.join(large(jump), "node").select("target", F.col("up").alias("node"))), "ways")
    return way.join(large(tree), "node").select("target", F.col("depth").alias("step"), F.col("node").alias("node_id"))


def drawing(nodes: DataFrame, lines: int = 50, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(line, text) of the first lines of the tree as text, with each node's operation, score and visits."""
    rows = intervals(nodes, {"_op": ("max", F.coalesce("operation", F.lit("root"))), "_s": ("max", F.lit(0)), "_v": ("max", F.lit(0))}, node=node, parent=parent).drop("_op", "_s", "_v")
    rows = materialize(rows, "intervals")
    total = rows.count()
    few = rows.where(F.col("place") < lines)  # a report's length; with a node come all above it
    ends = rows.select(F.col("node_id").alias("parent_id"), (F.col("place") + F.col("size")).alias("end"))
    few = materialize(few.join(large(ends), "parent_id", "left").withColumn("last", F.col("place") + F.col("size") == F.coalesce("end", F.lit(total))).drop("end"), "drawn")
    up = few.select(F.col("place").alias("p"), (F.col("place") + F.col("size")).alias("e"), F.col("depth").alias("d"), F.when(F.col("last"), "    ").otherwise("│   ").alias("bar"))
    bars = few.join(F.broadcast(up), (F.col("p") < F.col("place")) & (F.col("place") < F.col("e"))).groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "bar"))), lambda x: x["bar"]), "").alias("bars"))
    facts = nodes.dropDuplicates([node]).select(F.col(node).alias("node_id"), F.coalesce("operation", F.lit("root")).alias("op"), F.coalesce(F.col("score"), F.lit(0.0)).alias("s"), F.coalesce("visits", F.lit(0)).alias("v"))
    named = few.join(bars, "node_id", "left").join(facts, "node_id")
    text = F.concat(F.coalesce("bars", F.lit("")), F.when(F.col("last"), "└── ").otherwise("├── "), "op", F.lit(" (ID:"), "node_id", F.lit(") [score:"), F.format_string("%.5f", "s"), F.lit(", visits:"), "v", F.lit("]"))
    return named.select((F.col("place") + 1).alias("line"), text.alias("text"))

"""A trie of conversations by their turns, with what sharing of prefixes saves.

A node is a sequence of turns, named by its depth and by two 64-bit exclusive-ors of its turns' hashes, each hashed with its
place. The smallest member of a node owns it; since a member of a node is one of all nodes above, what a conversation owns is a
suffix of its path. So a node's subtree need not be walked: each member adds the bytes of the rest of its path, less those that
it owns itself, and one to the leaves if it ends in a leaf of its own. All this is one group-by of the rows (conversation, depth).

Scale: texts are hashed before they are shuffled once, to order turns of one number, and go no further. Running values come from windows
over conversations, and long conversations are cut into pieces (operators/series.py). The group-by sums in tasks first, so that the root, or a turn that a third of all
conversations share, is no hot task; joins have one row on one side for each conversation or node, and Spark splits a hot
one on the other. Ends of a node are put in order by ranges and packed into texts of RUN ids; only these meet in the task that
hashes them one after the other, as SHA-256 asks for.

Edge cases: null roles and texts are empty; turns that are equal in number are taken by role, then text. Rows without conv_id belong to no conversation.
Rows that are repeated are turns of their own. An empty table has no nodes. A remainder has its number's sign. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import MOST, running
from .common import materialize, read_table, ship

EACH, HEADS = 5, 9  # conversations that share a beginning, and one more than its longest
RUN = 4096


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, h1, h2, bytes) of the turns of rebuilt conversations, and (conv_id) of all of them, also those without turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), F.octet_length(text).cast("long").alias("bytes"), role.alias("role"), text.alias("text"))
    turns = running(turns, ["conv_id"], ["turn", "role", "text"], {"place": F.lit(1).cast("long")}, most=most)
    turns = materialize(turns.select("conv_id", "place", "h1", "h2", "bytes"), "turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": head_length(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % EACH})
    convs = materialize(convs, "conversations")
    heads = turns.where((F.col("conv_id") % EACH == 0) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("base"), "place", "h1", "h2", "bytes")
    first = convs.select("conv_id", "base", "h").join(heads, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "h1", "h2", "bytes")
    short = convs.where(F.col("conv_id") % EACH == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = turns.withColumns({"h": head_length(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % EACH}).where("place > h").join(short, "base", "left")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("base_n", F.lit(0)))).alias("depth"), "h1", "h2", "bytes")
    return first.unionByName(own), convs.select("conv_id")


def paths(turns: DataFrame, convs: DataFrame, most: int = MOST) -> DataFrame:
    """(conv_id, depth, k1, k2, up1, up2, bytes, before, last): a row for each node that a conversation is a member of.

    k1, k2 name the node, up1, up2 the one above; before: bytes of the turns before this one; last: whether the conversation ends here.
    """
    own = {f"k{i}": F.xxhash64(F.lit(i), F.col("depth"), F.col(f"h{i}")) for i in (1, 2)}
    path = running(turns, ["conv_id"], ["depth"], {"upto": F.col("bytes")}, own, most)
    rows = path.select("conv_id", F.col("depth").cast("long").alias("depth"), "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(own[f"k{i}"]).alias(f"up{i}") for i in (1, 2)], "bytes", (F.col("upto") - F.col("bytes")).alias("before"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"), zero.alias("bytes"), zero.alias("before"))
    return materialize(rows.unionByName(roots), "paths")


NODE = ["depth", "k1", "k2"]


def _joined(batches):
    """Runs of one node's ids as one text each: (depth, k1, k2, first, ids)."""
    for b in batches:
        keys = np.column_stack([b.column(i).to_numpy() for i in range(3)])
        ids = b.column(3).to_pylist()
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(ids) else np.array([], int)
        cuts = [c for a, z in zip(new, [*new[1:], len(ids)], strict=True) for c in range(a, z, RUN)]
        spans = list(zip(cuts, [*cuts[1:], len(ids)], strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[cuts, i], pa.int64()) for i in range(3)), pa.array([ids[a] for a in cuts], pa.int64()), pa.array([",".join(map(str, ids[a:z])) for a, z in spans], pa.string())], names=[*NODE, "first", "ids"])


def _hashed(batches):
    """(depth, k1, k2, ends_sha256) of sorted runs; a node's runs follow each other, over batches."""
    at, state = None, None
    for b in batches:
        out = []
        for *key, _, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if key != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(out)
    if at is not None:
        yield _digests([(*at, state.hexdigest())])


def _digests(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digest of the ids of the conversations that end in a node, ascending and comma-joined."""
    ship(ends.sparkSession)
    order = [*NODE, "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each node: its owner's conv_id, depth, and what its subtree holds; most: rows of a conversation beyond which it is cut into pieces."""
    turns, convs = rebuilt(conversations, most)
    path = paths(turns, convs, most)
    ends = path.groupBy("conv_id").agg(F.max("depth").alias("length"), F.sum("bytes").alias("total"))
    ends = materialize(ends, "lengths")
    path = path.join(ends, "conv_id").withColumn("more", F.col("depth") < F.col("length"))
    path = materialize(path, "members")
    # owners first: the node rows say where each conversation's owned suffix begins, and whether it ends in a leaf
    nodes = materialize(path.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("more").alias("more"), F.min("before").alias("before")), "owners")
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("own_from"), F.min("before").alias("own_before"), F.max((~F.col("more")).cast("long")).alias("leaf"))
    member = path.join(owned, "conv_id", "left")
    shared = F.greatest(F.coalesce("own_before", "total") - F.col("before"), F.lit(0))  # bytes from here on that it doesn't own
    below = F.when(F.col("more") & (F.col("depth") + 1 >= F.col("own_from")), 1).otherwise(0)
    sums = member.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.count("*").alias("n_convs"), F.sum(below).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(shared).alias("saved_tokens"),
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("owner").alias("parent_conv_id"))
    done = sums.join(above, ["depth", "up1", "up2"], "left")
    digests = ends_digests(path.where(~F.col("more")))
    empty = hashlib.sha256(b"").hexdigest()
    out = done.join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


_CRC = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(unicode(ch) AS BIGINT))), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"
SQL = f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, list({{'r': r, 't': t}} ORDER BY p) AS own, xor({_CRC}, 4294967295) % 9 AS h FROM o GROUP BY c),
b AS (SELECT k.c, list_concat(coalesce(x.own[1:k.h], []), k.own[k.h + 1:]) AS path FROM k LEFT JOIN k x ON x.c = k.c - k.c % 5),
m AS (SELECT c, path, d, path[1:d] AS node FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM b)),
n AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(path) = d), '')) AS ends FROM m GROUP BY d, node),
s AS (SELECT n.d, n.node, count(*) FILTER (x.d = n.d + 1) AS n_children, sum(CASE WHEN x.d > 0 THEN (x.n_convs - 1) * strlen(x.node[x.d].t) ELSE 0 END) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM n y WHERE y.d = x.d + 1 AND y.node[1:x.d] = x.node)) AS leaves FROM n JOIN n x ON x.d >= n.d AND x.node[1:n.d] = n.node GROUP BY n.d, n.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(s.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.node = n.node LEFT JOIN n u ON u.d = n.d - 1 AND u.node = n.node[1:n.d - 1]
"""

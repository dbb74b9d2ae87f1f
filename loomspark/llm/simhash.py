"""Near-duplicate groups by SimHash, with candidates from a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts. The Manhattan
distance of two such vectors never exceeds the fingerprints' Hamming distance, so a range join under it loses no
pair. The grid: the segments are dealt into six blocks; two vectors within distance 3 agree on at least three
blocks, so each vector goes to the 20 cells that its blocks, three at a time, make up. Within a cell the Manhattan
bound is tested first and the Hamming distance decides.

Counts of one segment are written as 00, 01, 11, so that the Manhattan distance of two vectors is the bit count of
an exclusive or.

Scale: exact copies collapse to one fingerprint before any cell is made. Cells with many members are cut into
pieces, and pairs of pieces are separate groups of bounded size. A group returns a spanning forest of its links,
never all its pairs. Components come from rounds of star contraction over tables in the shared folder.

A cell agrees on 16 segments of about 1.5 bits each, so pairs within cells stay few up to some 10^9 different
fingerprints; `near_links(blocks=8)` agrees on 20, with 56 cells a fingerprint, for more.

Edge cases: ids are whole numbers (near_links and connected_components also take fingerprints as ids); null or blank texts have fingerprint zero and link like any other; repeated rows get equal results; a
null doc_id counts in no component and gets the component of its text's other documents, or null; an empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_table, materialize, ship, slices

RADIUS = 3
BLOCKS = 6
PIECE = 1024
_ODD = 0x5555555555555555


def _fingerprint(raw: bytes, width: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each text as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            fps = np.array([_fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), as_bytes(F.col(text_col)).alias("raw")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def popcount_embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each written as 00, 01 or 11."""
    odd = F.lit(_ODD)
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(odd), fp.bitwiseAND(high).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cell_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the blocks, blocks - radius at a time, as signed longs."""
    lanes = np.array_split(np.arange(32), blocks)
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(3 << (2 * int(i)) for b in chosen for i in lanes[b])
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _forest(fps: np.ndarray, embedded: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the graph that links fingerprints within radius."""
    n = len(fps)
    rest, edges = np.arange(1, n), []
    queue, at = [0], 0
    while at < len(queue) or len(rest):
        if at == len(queue):
            queue.append(int(rest[0]))
            rest = rest[1:]
        i = queue[at]
        at += 1
        if not len(rest):
            continue
        near = np.bitwise_count(embedded[rest] ^ embedded[i]) <= radius
        near[near] = np.bitwise_count(fps[rest[near]] ^ fps[i]) <= radius
        found = rest[near].tolist()
        edges += [(i, j) for j in found]
        queue += found
        rest = rest[~near]
    return edges


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, piece: int = PIECE) -> DataFrame:
    """Links (u, v) between representatives of distinct fingerprints, enough to connect all within radius.

    fps: (fp, rep), each fp once.
    """
    masks = _cell_masks(blocks, radius)
    placed = fps.where("rep is not null").withColumn("emb", popcount_embedding(F.col("fp")))
    cells = F.explode(F.array(*[F.struct(F.lit(j).cast("smallint").alias("j"), F.col("emb").bitwiseAND(F.lit(m)).alias("cell")) for j, m in enumerate(masks)]))
    member = placed.select("fp", "rep", cells.alias("c")).select("fp", "rep", "c.j", "c.cell")
    shared = member.groupBy("j", "cell").agg(F.count("*").alias("n")).where("n > 1")
    n_pieces = F.ceil(F.col("n") / piece)
    own = F.pmod(F.xxhash64("fp"), n_pieces)
    dealt = (
        member.join(shared, ["j", "cell"])
        .select("j", "cell", "fp", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), n_pieces - 1)).alias("other"))
        .groupBy("j", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
        .where(F.size("fps") > 1)
    )

    def run(batches):
        odd = np.uint64(_ODD)
        for b in slices(batches):
            left, right = [], []
            for f, r in zip(b.column(0), b.column(1), strict=True):
                fp = f.values.to_numpy().view(np.uint64)
                high = fp >> np.uint64(1)
                emb = ((fp | high) & odd) | ((fp & high & odd) << np.uint64(1))
                reps = r.values.to_numpy()
                for i, k in _forest(fp, emb, radius):
                    left.append(max(reps[i], reps[k]))
                    right.append(min(reps[i], reps[k]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return dealt.select("fps", "reps").mapInArrow(run, "u bigint, v bigint").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge (u > v), by star contraction."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, materialize(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(last)
        if mark == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = mark


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for each row of docs."""
    own = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reps = materialize(own.groupBy("fp").agg(F.min(id_col).alias("rep")), "distinct-fingerprints")
    parts = connected_components(near_links(reps, radius))
    named = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp").select(id_col, "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

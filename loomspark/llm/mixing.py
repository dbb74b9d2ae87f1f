"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are put in a fixed shuffled order and cut into blocks of equally many words. The schedule is
one row of slots for all sources: slot i falls to the source in whose share of the unit interval the golden-ratio point
frac(i * phi) lies, so that every prefix of the schedule is close to the target weights. A source's slots are ranked in the order of
the schedule; its r-th slot takes block r, from the first block again after the last one, until the source's target is met: its
last slot takes only the words still wanted. A document's `first_slot` is the first slot that takes words of it.

A source's share is as many of F equal places as it needs slots, one for each of its blocks in each pass, however small it is. F is a
Fibonacci number, and phi the quotient of the one before it and F, so that F slots have one point in each place (a Fibonacci lattice):
every source gets exactly the slots it needs. Places beyond all shares are nobody's, and their slots are left out.

Targets: weights 3, 1, 2, repeating over the sources by code point (null last), share a total of 1.5 times all words;
no target exceeds twice its source's words, and what is cut off is shared again by weight among the others.

Scale: running sums are taken in three levels, within chunks of some 4,096 rows, over chunks and over runs of
1,024 chunks, so that a hot source is never in one task. Sources themselves are sorted in one, a row each. There are at most SLOTS slots and three for each source, whatever the input;
places are dealt in chunks, and the slot of each is found by the inverse of the step.

Edge cases: null texts have size 0 and are never taken; null is a source like others; rows repeated in full are
separate documents; a table without words has targets of 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_GAP, materialize, read_table, words_of

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MOST_PASSES = 1.5, 2.0
SLOTS = 1 << 18
CHUNK, RUN = 4096, 1024  # rows in a chunk, chunks in a run
MAX_BROADCAST_ROWS = 100_000


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, k, target) for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_fill, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", "k"), Window.partitionBy()
    pattern = F.array(*[F.lit(w) for w in WEIGHTS])
    # water level: sources fill up in the order of most / weight; the level is what the unfilled ones share a weight
    filled = (
        per.withColumn("k", F.row_number().over(by_name).cast("int") - 1)
        .withColumn("weight", F.get(pattern, F.col("k") % len(WEIGHTS)))
        .withColumn("most", MOST_PASSES * F.col("source_size"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", TOTAL_SHARE * F.sum("source_size").over(all_rows))
        .withColumn("cut", F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cut")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_rows))
        .withColumn("target", F.least("most", F.col("weight") * F.coalesce("level", F.lit(0.0))))
    )
    return filled.select("source", "source_size", "k", "target")


def _running(df: DataFrame, keys: list[str], chunk: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """The sum of amount before each row, by keys, in the order (chunk, order): within chunks, over chunks, and over runs of chunks; df is read twice."""
    upto = lambda *by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(amount).alias("_sum")).withColumn("_run", F.floor(F.col(chunk) / RUN))
    runs = sums.groupBy(*keys, "_run").agg(F.sum("_sum").alias("_all"))
    runs = runs.select(*keys, "_run", F.coalesce(F.sum("_all").over(upto(*keys, order=["_run"])), F.lit(0)).alias("_before_run"))
    near = F.coalesce(F.sum("_sum").over(upto(*keys, "_run", order=[chunk])), F.lit(0))
    sums = sums.withColumn("_near", near).join(runs, [*keys, "_run"]).select(*keys, chunk, (F.col("_near") + F.col("_before_run")).alias("_before"))
    inner = F.coalesce(F.sum(amount).over(upto(*keys, chunk, order=order)), F.lit(0))
    return df.withColumn("_inner", inner).join(sums, [*keys, chunk]).withColumn(out, (F.col("_before") + F.col("_inner")).cast("long")).drop("_before", "_inner")


def lattice(n: int) -> tuple[int, int]:
    """(step, size): neighbouring Fibonacci numbers, the second at least n; their quotient is the golden ratio's fraction."""
    step, size = 1, 1
    while size < n:
        step, size = size, step + size
    return step, size


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """(slot, at, k, rank, block_no, words): each slot's place in the schedule, also as a share of it, its source, and the block and words that it takes."""
    wanted, size = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    per_pass, turns = F.ceil(size / block), F.floor(wanted / size)
    needs = shares.select("k", "source_size", wanted.alias("wanted"), per_pass.alias("per_pass"), (turns * per_pass + F.ceil((wanted - turns * size) / block)).alias("n")).where("n > 0")
    needs = needs.withColumn("first", F.sum("n").over(Window.orderBy("k")) - F.col("n"))  # a row a source
    step, places = lattice(needs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    chunks = needs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("part"))  # at most 2 * SLOTS / CHUNK + 3 rows a source
    own = F.sequence(F.col("first") + F.col("part") * CHUNK, F.col("first") + F.least(F.col("n"), (F.col("part") + 1) * CHUNK) - 1)
    placed = chunks.repartition("k", "part").select("k", "source_size", "wanted", "per_pass", F.explode(own).alias("place"))
    # slot i has the point frac(i * step / places), which is place i * step mod places
    slots = placed.withColumn("slot", F.col("place") * pow(step, -1, places) % places).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    ranked = _running(slots, ["k"], "chunk", [F.col("slot")], F.lit(1), "rank")
    turn = F.floor(F.col("rank") / F.col("per_pass"))
    no = (F.col("rank") - turn * F.col("per_pass")).cast("long")
    done = turn * F.col("source_size") + no * block  # words of the source taken by its earlier slots
    whole = F.least(F.lit(block), F.col("source_size") - no * block)
    return ranked.select("slot", (F.col("slot") / F.lit(places)).alias("at"), "k", "rank", no.alias("block_no"), F.least(whole, F.col("wanted") - done).cast("long").alias("words"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", slots: int = SLOTS) -> DataFrame:
    """(id, size, source, source_size, target, taken, first_slot) for each row of docs; no slot takes from rows of which nothing is taken."""
    size = F.size(words_of(F.col(text_col), SPACE_GAP)).cast("long")
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))  # the order within a source
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), spread.alias("h")), "sizes")
    shares = materialize(targets(sizes), "targets")
    stats = sizes.agg(F.count("*"), F.sum("size")).first()
    n_docs, total = stats[0], TOTAL_SHARE * (stats[1] or 0)
    block = max(16, int(total // slots) + 1)
    plan = schedule(shares, block)
    # a source's blocks, each with the words that all its slots take from it, from its start
    passes = plan.groupBy("k", "block_no").agg(F.collect_list(F.struct("slot", "words")).alias("takes"))

    few = shares.count() <= MAX_BROADCAST_ROWS
    named = shares.select(F.col("source").alias("src"), "k", "source_size", "target")
    owned = sizes.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    chunks = n_docs // CHUNK + 1
    shuffled = owned.withColumn("chunk", F.pmod(F.shiftright("h", 20), F.lit(chunks)))
    placed = _running(shuffled, ["k"], "chunk", [F.col("h"), F.col("id"), F.col("size")], F.col("size"), "start")
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select(
        "id", "k", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block_no")
    )
    lo = F.greatest(F.col("start"), F.col("block_no") * block) - F.col("block_no") * block
    hi = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block) - F.col("block_no") * block
    taken = (
        pieces.withColumns({"lo": lo, "hi": hi}).join(passes, ["k", "block_no"])
        .withColumn("n", F.aggregate("takes", F.lit(0).cast("long"), lambda acc, t: acc + F.greatest(F.lit(0), F.least(F.col("hi"), t["words"]) - F.col("lo"))))
        .withColumn("slot", F.array_min(F.transform(F.filter("takes", lambda t: t["words"] > F.col("lo")), lambda t: t["slot"])))
        .groupBy("k", "start", "id").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    )
    full = placed.join(taken.where("taken > 0").withColumnRenamed("id", "tid"), (F.col("id").eqNullSafe(F.col("tid"))) & (placed.k == taken.k) & (placed.start == taken.start) & (placed["size"] > 0), "left")
    return full.select(placed.id.alias(id_col), "size", placed.source, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")

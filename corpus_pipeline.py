"""A training-corpus pipeline: each stage reads what the one before it kept.

Stages take (spark, docs, sf_dir) and return a table; all but the last return the columns of documents. Tables between
stages are Parquet in the folder that driver and executors share.

Edge cases: a stage passes on an empty table as one; documents with null or empty text are clean, are near
duplicates of each other, and are taken by no mix. Rows that share a doc_id, or have none, but differ in their texts are
documents of their own; of rows with one id and text the one whose hash is least stays. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontamination, mixing, simhash, token_store
from loomspark.llm import toxicity as toxic
from loomspark.llm.common import fold, materialize, read_table


def _row_key() -> Column:
    """What tells documents apart: the doc_id (null last) and the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): each document's key, and all its columns, whatever they are called."""
    return docs.select(_row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    labels = read_table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")
    scored = toxic.score(docs, toxic.train(docs, labels), keep={f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    return scored.where("predicted = 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last), then the least hash of its text, of each group of near duplicates, once."""
    own = materialize(simhash.fingerprints(docs.select(_row_key().alias("key"), "text"), "key"), "fingerprints")
    fps = materialize(own.select("fp").distinct(), "distinct-fingerprints")
    parts = simhash.connected_components(simhash.near_links(fps.select("fp", F.col("fp").alias("rep"))))  # fingerprints are their own nodes, whatever ids are
    grouped = own.join(parts, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("component"))
    kept = grouped.agg(F.min("key").alias("first"))
    rows = _keyed(docs).join(kept, F.col("key") == F.col("first"), "left_semi")
    return rows.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")  # rows that differ elsewhere: the one of the least hash


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    found = decontamination.find_overlaps(docs, read_table(spark, sf_dir, "benchmark"))
    bad = found.where(decontamination.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash").alias("bad"))
    bad = decontamination.few(materialize(bad, "contaminated"))
    return _keyed(docs).join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: 0, 1 or 2 times, to the nearest."""
    keyed = docs.select(_row_key().alias("key"), "text", "source")
    taken = mixing.mix(keyed, "key").groupBy(F.col("key").alias("taken")).agg(F.coalesce(F.round(F.try_divide(F.sum("taken"), F.sum("size"))), F.lit(0)).cast("int").alias("copies"))
    rows = _keyed(docs).join(taken.where("copies > 0"), F.col("key") == F.col("taken"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's token ids stand in the stored shards."""
    return token_store.write_and_read(docs, token_store.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]

#: SQL has no Kneser-Ney models, connected components or tokenizer; tests/llm holds the rows that the middle stages keep against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

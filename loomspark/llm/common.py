"""Helpers that several corpus operators share: shared-folder tables, text columns, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401
from ..storage import drop_table, materialize, shared_root, workspace  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words made of ASCII letters, digits and every non-ASCII character (of lower-cased text).
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words made of everything but ASCII white space.
SPACE_GAP = r"[\x20\x09-\x0D]+"

def slices(batches, rows: int = 1000):
    """Arrow batches (Spark bounds their bytes) as batches of fewer rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, gap: str = WORD_GAP) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, though body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def below(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among this share of all; exact for any share, however small."""
    return F.lit(True) if share >= 1 else h < F.lit(int(share * 2**64) - 2**63)


def as_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")

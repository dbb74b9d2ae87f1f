"""Toxicity by class-conditional Kneser-Ney models over words.

For either class y, a pair of words v w counts by its distinct left neighbours in texts of the class, N1(. v w | y), and a
word by its distinct left neighbours, N1(. w | y): copies of a text add nothing. Each order discounts its counts by
D = n1 / (n1 + 2 n2), n1 and n2 being how many counts are 1 and 2, and hands the mass down:

    p2(w | v, y) = max(N1(. v w | y) - D2, 0) / N1(. v . | y) + lambda(v, y) * p1(w | y)
    p1(w | y)    = max(N1(. w | y) - D1, 0) / N1(. . | y) + lambda(y) * p_shared(w)
    p_shared(w)  = (N1(. w) + base) / (N1(. .) + base * (V + 1))

p_shared has the counts of both classes, so that a rare expression scores nearly alike under both. A word's evidence is
log p(w | toxic) - log p(w | ordinary); a text's is the mean over its strongest stretch of a number of words (0: the
whole text), which normalises by length; a logistic curve in this one number is the score.

Training fits on a bounded sample of labelled rows: about `most_toxic` and `most_ordinary` rows by hash of doc_id, pairs
on about `most_pairs` of either. Order, stretch and base are chosen by log loss, and the curve is fitted, on evidence that
each quarter of the sample gets from the counts of the other three (counts are taken within quarters, and added up).
Where words follow each other by chance, pairs add only noise, and order one is taken.

Edge cases: null and empty texts have evidence 0; labels that are null are left out, a doc_id labelled twice is toxic if
either label is; without labels of both classes every score is 0; repeated rows get equal scores; of equal losses the
lower order, longer stretch and smaller base wins. Texts are used whole. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, below, fold, read_table, ship, slices

ORDERS, STRETCHES, BASES = (1, 2), (0, 16, 4, 1), (0.5, 5.0, 50.0, 500.0)
MOST_TOXIC, MOST_ORDINARY, MOST_PAIRS = 2000, 4000, 800
THRESHOLD = 0.7
PARTS = 4
#: Bytes that stand between words become spaces, A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_in(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of these counts, 0.5 where either is missing."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


class Lexicon:
    """A number or value for each word; looked up in a dictionary that a worker makes once, and the driver never."""

    def __init__(self, words: pa.Array, values: np.ndarray | None = None):
        self.words, self.values, self._found = words, values, None

    def __len__(self) -> int:
        return len(self.words)

    def __getstate__(self):
        return {"words": self.words, "values": self.values, "_found": None}

    @property
    def get(self):
        if self._found is None:
            self._found = dict(zip(self.words.to_pylist(), range(len(self.words)) if self.values is None else self.values.tolist(), strict=True))
        return self._found.get


class Words:
    """p1 of both classes for words by their numbers; the last number is any other word's."""

    def __init__(self, counts: np.ndarray):
        """counts: words by class (ordinary, toxic)."""
        self.counts = np.vstack([counts, np.zeros((1, 2))]).astype(np.int32)
        self.total = self.counts.sum(axis=0, dtype=np.int64).astype(np.float64)
        self.discount = np.array([discount(self.counts[:, y]) for y in (0, 1)])
        self.left = self.discount * (self.counts > 0).sum(axis=0) / np.maximum(self.total, 1)

    def p(self, ids: np.ndarray, base: float) -> np.ndarray:
        own = self.counts[ids]
        shared = (own.sum(axis=1) + base) / (self.total.sum() + base * len(self.counts))
        return np.maximum(own - self.discount, 0) / np.maximum(self.total, 1) + self.left * shared[:, None]


def log_ratio(p: np.ndarray) -> np.ndarray:
    return np.log(p[:, 1] / p[:, 0])


class Pairs:
    """What p2 adds to p1: for pairs of word numbers, the share of their own and that of p1, by class."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, size: int):
        """codes: v * (size + 1) + w of each pair, ascending; counts: pairs by class; size: words in the vocabulary."""
        self.codes, self.step = codes, size + 1
        v = codes // self.step
        self.own, self.rest = np.zeros((len(codes), 2)), np.ones((size + 1, 2))
        for y in (0, 1):
            d = discount(counts[:, y])
            total = np.bincount(v, counts[:, y], size + 1)
            kinds = np.bincount(v, counts[:, y] > 0, size + 1)
            seen = total > 0
            self.rest[seen, y] = d * kinds[seen] / total[seen]
            self.own[:, y] = np.maximum(counts[:, y] - d, 0) / np.maximum(total[v], 1)

    def p(self, p1: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """p2 of a text's words, given their numbers and p1."""
        before = np.concatenate([[self.step - 1], ids[:-1]])  # a text starts after a word that is in no pair
        code = before * self.step + ids
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        own = np.where((self.codes[at] == code)[:, None], self.own[at], 0.0) if len(self.codes) else 0.0
        return own + self.rest[before] * p1


def strongest(v: np.ndarray, stretch: int) -> float:
    """The largest mean of this many values in a row (0, or fewer values: of all)."""
    if not len(v):
        return 0.0
    if not stretch or len(v) < stretch:
        return float(v.sum() / max(len(v), stretch))
    sums = np.concatenate([[0.0], np.cumsum(v)])
    return float((sums[stretch:] - sums[:-stretch]).max() / stretch)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Slope, bias and log loss of a logistic regression in one number, by Newton steps."""
    mean, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w, weight = np.zeros(2), weight / weight.sum()
    penalty = np.diag([ridge, 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale), loss


def _word_counts(sample: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The vocabulary of the bounded sample, and the distinct left neighbours of each word by 2 * part + class."""

    def run(batches):
        for b in slices(batches):
            out = set()
            for raw, y, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ws = words_in(raw)
                k = 2 * part + y
                out.update((k, v, w) for v, w in zip([b"", *ws], ws, strict=False))
            k, v, w = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v, pa.binary()), pa.array(w, pa.binary())], names=["k", "v", "w"])

    distinct = sample.select("raw", "y", "part").mapInArrow(run, "k int, v binary, w binary").select("k", F.xxhash64("v").alias("v"), "w").distinct()
    table = distinct.groupBy("w").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in range(2 * PARTS)]).toArrow()
    return pa.array(table.column("w").combine_chunks(), pa.binary()), np.stack([table.column(f"n{k}").to_numpy() for k in range(2 * PARTS)], axis=1).astype(np.int32)


def _pair_counts(sample: DataFrame, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs in the part of the sample for pairs, and their distinct left neighbours by 2 * part + class."""

    def run(batches):
        for b in slices(batches):
            out = set()
            for raw, y, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ws = words_in(raw)
                k = 2 * part + y
                out.update((k, u, v, w) for u, v, w in zip([b"", *ws], ws, ws[1:], strict=False))
            k, u, v, w = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in (u, v, w))], names=["k", "u", "v", "w"])

    distinct = sample.select("raw", "y", "part").mapInArrow(run, "k int, u binary, v binary, w binary").select("k", F.xxhash64("u").alias("u"), "v", "w").distinct()
    table = distinct.groupBy("v", "w").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in range(2 * PARTS)]).toArrow()
    step = len(vocabulary) + 1
    v, w = (pc.index_in(table.column(c).combine_chunks(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "w"))
    codes = v * step + w
    order = np.argsort(codes)
    return codes[order], np.stack([table.column(f"n{k}").to_numpy() for k in range(2 * PARTS)], axis=1).astype(np.int32)[order]


def _sum(counts: np.ndarray, without: int | None = None) -> np.ndarray:
    """Counts by class of all parts of the sample, or of all but one."""
    return sum(counts[:, 2 * k : 2 * k + 2] for k in range(PARTS) if k != without)


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", most_toxic=MOST_TOXIC, most_ordinary=MOST_ORDINARY, most_pairs=MOST_PAIRS, orders=ORDERS, stretches=STRETCHES, bases=BASES) -> dict | None:
    """A model from the texts of docs that labels marks; None unless both classes occur."""
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
    n = Counter({r[0]: r[1] for r in marked.groupBy("y").count().collect()})
    if len(n) < 2:
        return None
    share = {1: min(1.0, most_toxic / n[1]), 0: min(1.0, most_ordinary / n[0])}
    h = F.xxhash64(F.lit("toxicity"), F.col("id"))
    toxic = F.col("y") == 1
    chosen = marked.where((toxic & below(h, share[1])) | (~toxic & below(h, share[0])))
    for_pairs = F.xxhash64(F.lit("pairs"), F.col("id"))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(PARTS)).cast("int")).withColumn(
        "paired", (toxic & below(for_pairs, most_pairs / max(1, min(n[1], most_toxic)))) | (~toxic & below(for_pairs, most_pairs / max(1, min(n[0], most_ordinary))))
    )
    # at most about most_toxic + most_ordinary rows, so it may be broadcast
    sample = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("raw")).join(F.broadcast(chosen), "id")

    vocabulary, counts = _word_counts(sample)
    if not len(vocabulary) or not _sum(counts).sum(axis=0).all():
        return None
    codes, pair_counts = _pair_counts(sample.where("paired"), vocabulary) if 2 in orders else (np.zeros(0, np.int64), np.zeros((0, 2 * PARTS), np.int32))
    split = all(_sum(counts, k).sum(axis=0).all() for k in range(PARTS))  # both classes are left whichever part goes
    shared = spark.sparkContext.broadcast((Lexicon(vocabulary), counts, codes, pair_counts))  # the vocabulary and pairs of the bounded sample

    def evidence(batches):
        number, counts, codes, pair_counts = shared.value
        parts = [(Words(_sum(counts, k)), Pairs(codes, _sum(pair_counts, k), len(number))) for k in (range(PARTS) if split else [None])]
        for b in slices(batches):
            x = []
            for raw, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, pairs = parts[part % len(parts)]
                ws, found = words_in(raw), []
                ids = np.fromiter((number.get(w, len(number)) for w in ws), np.int64, len(ws))
                for order in orders:
                    for base in bases:
                        p = words.p(ids, base)
                        v = log_ratio(pairs.p(p, ids) if order == 2 and len(ids) else p)
                        found += [strongest(v, k) for k in stretches]
                x.append(found)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    seen = sorted((r.y, tuple(r.x)) for r in sample.select("raw", "y", "part").mapInArrow(evidence, "y int, x array<double>").collect())  # some numbers for each row of the bounded sample
    shared.unpersist()
    if len({y for y, _ in seen}) < 2:
        return None
    y, x = np.array([s[0] for s in seen], np.float64), np.array([s[1] for s in seen])
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    kinds = [(order, base, stretch) for order in orders for base in bases for stretch in stretches]
    fits = [_fit_curve(x[:, i], y, weight) for i in range(len(kinds))]
    best = min(range(len(kinds)), key=lambda i: round(fits[i][2], 6))
    order, base, stretch = kinds[best]
    words = Words(_sum(counts))
    out = {"order": order, "stretch": stretch, "base": base, "slope": fits[best][0], "bias": fits[best][1], "losses": {k: f[2] for k, f in zip(kinds, fits, strict=True)}}
    if order == 1:
        ratio = log_ratio(words.p(np.arange(len(vocabulary) + 1), base))
        return out | {"ratio": Lexicon(vocabulary, ratio[:-1]), "other": float(ratio[-1])}
    return out | {"number": Lexicon(vocabulary), "words": words, "pairs": Pairs(codes, _sum(pair_counts), len(vocabulary))}


def evidence_of(raw: bytes, model: dict) -> float:
    """The mean log ratio of a text's strongest stretch."""
    ws = words_in(raw)
    if not ws:
        return 0.0
    if model["order"] == 1:
        get, other = model["ratio"].get, model["other"]
        v = np.fromiter((get(w, other) for w in ws), np.float64, len(ws))
    else:
        number = model["number"]
        ids = np.fromiter((number.get(w, len(number)) for w in ws), np.int64, len(ws))
        v = log_ratio(model["pairs"].p(model["words"].p(ids, model["base"]), ids))
    return strongest(v, model["stretch"])


def score(docs: DataFrame, model: dict | None, text_col="text", keep: dict[str, Column] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of keep (by name), with score and predicted."""
    spark = docs.sparkSession
    ship(spark)
    keep = keep or {}
    shared = spark.sparkContext.broadcast(model)  # at most the vocabulary and pairs of the bounded sample
    names = [f"_keep{i}" for i in range(len(keep))]
    cols = docs.select(*[c.alias(n) for n, c in zip(names, keep.values(), strict=True)], as_bytes(F.col(text_col)).alias("_raw"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema.fields[:-1])

    def run(batches):
        m = shared.value
        for b in slices(batches):
            x = np.array([evidence_of(raw, m) for raw in b.column(b.num_columns - 1).to_pylist()]) if m else np.zeros(b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(x * m["slope"] + m["bias"], -30, 30))) if m else x
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*names, "_score"])

    out = cols.mapInArrow(run, f"{schema}_score double")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "toxic"))
    return score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": fold(F.col("doc_id"), 3) == 1})

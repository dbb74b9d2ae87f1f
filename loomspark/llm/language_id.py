"""Language identification in two steps: the language family, then the language within it.

Both steps use linear support vector machines, one against one, over hashed counts of one to three letters. A
family with one learned language needs no second step.

Training fits on a bounded sample: at most about `per_language` rows of each language (a row is taken if the 64-bit
hash of its doc_id and text falls below the share that gives this many). Everything else reads all rows.

Edge cases: null texts and texts without a letter are `und` with score 0; without labelled rows every text is `und`;
repeated rows get equal results; languages that the table of families doesn't have are families of their own. Texts
are used whole. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, fold, read_table, ship, slices

UND = "und"
DIM = 4096
PER_LANGUAGE = 400
#: Language families by language code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "iranian": ("fa", "ku", "ps"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("am", "ar", "he"),
    "malayic": ("id", "ms", "tl"),
    "sinitic": ("yue", "zh"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed counts of one to three letters; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one space for each gap
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    x = np.zeros(DIM, np.float32)
    a, b = c * np.uint32(2654435761), c * np.uint32(2246822519)
    for h in (a[1:-1], a[:-1] + (b[1:] ^ np.uint32(0x5BD1E995)), a[:-2] + (b[1:-1] ^ np.uint32(0x27D4EB2F)) + c[2:] * np.uint32(3266489917)):
        x += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(7) & np.uint32(DIM - 1), minlength=DIM)
    x = np.sqrt(x)
    return x / np.linalg.norm(x)


def _fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)  # classes weigh alike
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 / c + 2 * 2)  # rows have norm sqrt(2), weights sum to 1
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        grad = v / c - 2 * x.T @ (share * gap * y)
        new = v - rate * grad
        v, w = new + t / (t + 3) * (new - w), new
    return w


def _one_against_one(x: np.ndarray, names: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The names, and a row of weights for each pair of them, in the order of combinations()."""
    kinds = sorted(set(names))
    rows = [_fit_svm(x[m := (names == a) | (names == b)], np.where(names[m] == a, 1, -1).astype(np.float32)) for a, b in combinations(kinds, 2)]
    return kinds, np.array(rows, np.float32).reshape(len(rows), x.shape[1] + 1)


def _shares(x: np.ndarray, kinds: list[str], weights: np.ndarray) -> np.ndarray:
    """Rows by kinds: the mean of the pairwise probabilities, scaled to sum to 1."""
    p = np.zeros((len(x), len(kinds)), np.float64)
    if len(kinds) == 1:
        return p + 1
    margins = x @ weights[:, :-1].T + weights[:, -1]
    for (i, j), m in zip(combinations(range(len(kinds)), 2), margins.T, strict=True):
        q = 1 / (1 + np.exp(-4 * m.astype(np.float64)))
        p[:, i] += q
        p[:, j] += 1 - q
    return p / p.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE) -> dict | None:
    """A model from rows with text and language; None if there are none."""
    spark = labelled.sparkSession
    ship(spark)
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h, chosen = F.xxhash64(F.lit("lang"), F.col(text_col)), F.lit(False)
    counts = dict(usable.groupBy(lang_col).agg(F.approx_count_distinct(h, 0.02)).collect())  # a row a language
    if not counts:
        return None
    for lang, n in counts.items():
        chosen = F.when(F.col(lang_col) == lang, below(h, per_language / max(n, 1))).otherwise(chosen)
    # copies are one text, in the count and in the sample, whatever their ids
    sample = usable.where(chosen).groupBy(F.col(lang_col).alias("lang"), h.alias("h")).agg(F.min(text_col).alias("text")).select("text", "lang")

    def run(batches):
        for b in slices(batches):
            found = [(lang, x.astype("<f2").tobytes()) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (x := features(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in sample.mapInArrow(run, "lang string, x binary").collect())  # about per_language rows of each language
    if not rows:
        return None
    x = np.array([np.frombuffer(r[1], "<f2") for r in rows], np.float32)
    lang = np.array([r[0] for r in rows], object)
    family = np.array([_FAMILY_OF.get(v.lower().split("-")[0], v) for v in lang], object)
    names, weights = _one_against_one(x, family)
    return {"families": names, "weights": weights, "within": {f: _one_against_one(x[family == f], lang[family == f]) for f in names}}


def predict(model: dict | None, texts: list) -> tuple[list[str], list[float]]:
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    found = [(i, x) for i, t in enumerate(texts) if model and (x := features(t)) is not None]
    if not found:
        return langs, scores
    x = np.array([f[1] for f in found])
    p = _shares(x, model["families"], model["weights"])
    best = p.argmax(axis=1)
    for k, name in enumerate(model["families"]):
        rows = np.nonzero(best == k)[0]
        if not len(rows):
            continue
        kinds, weights = model["within"][name]
        q = _shares(x[rows], kinds, weights)
        for r, row in zip(rows, q, strict=True):
            i = found[r][0]
            langs[i], scores[i] = kinds[int(row.argmax())], float(min(1.0, p[r, k] * row.max()))
    return langs, scores


def identify(docs: DataFrame, model: dict | None, text_col="text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns of keep (by name), with lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: a row of weights for each pair
    cols = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])

    def run(batches):
        for b in slices(batches):
            langs, scores = predict(shared.value, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return cols.mapInArrow(run, f"{schema}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out).select("text", "lang"))
    return identify(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})

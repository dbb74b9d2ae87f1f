"""Scoring texts with a Brown class-based bigram model.

Words are put in classes by exchange, so that the likelihood of the corpus under class transitions grows, and

    p(word | previous) = p(class | previous class) * (count + 1) / (class tokens + class words + 1)

with transitions smoothed by the classes' frequencies. The exchange has two parts. The TOP most frequent words, and all
others by groups of equal endings, are exchanged one by one until nothing moves, on a matrix of their transitions.
Then every word of the training texts, however rare, moves to the class that its own neighbours ask for: the classes
before and after it are counted for the whole vocabulary on Spark, and all words move at once, as in distributed
exchange. Transitions and emissions are counted anew after that. A word that training has not seen has the class
of its ending.

Scale: counts are summed within tasks before they are shuffled. Frequent words (at most FREQUENT) are looked up in
a broadcast table; all other words of a text are joined with the whole vocabulary by a shuffle, where no key is frequent.
A word has at most 2 * CLASSES neighbour counts. What texts need besides is in the shared folder.

Edge cases: null and empty texts have the end token only; without training texts every count is 0 and scores are
those of the smoothing alone; repeated rows get equal scores; of classes with equal gain the present one, then the first
counts. Texts are used whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, materialize, read_table, ship, slices

END = b""
TOP, GROUPS, CLASSES = 768, 256, 64
FREQUENT = 200_000
FAN = 256
FLUSH = 300_000
MOST_SWEEPS = 100  # more than any exchange takes: each move raises the likelihood
KAPPA = 5.0


class _Groups(dict):
    """The group of a word's last three bytes; computed once for each ending."""

    def __missing__(self, ending: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        self[ending] = g = zlib.crc32(ending) % GROUPS
        return g


def _tokens(raw: bytes) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space, and the end."""
    words = raw.lower().split()
    words.append(END)
    return words


def count_words(docs: DataFrame, text_col="text") -> DataFrame:
    """(w, g, n): how often each token occurs, and the group of its ending."""
    ship(docs.sparkSession)

    def run(batches):
        counts, groups = Counter(), _Groups()

        def rows():
            words = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([groups[w[-3:]] for w in words], pa.int32()), pa.array(counts.values(), pa.int64())], names=["w", "g", "n"])
            counts.clear()
            return out

        for b in slices(batches):
            for raw in b.column(0).to_pylist():
                counts.update(_tokens(raw))
            if len(counts) > FLUSH:
                yield rows()
        yield rows()

    return docs.select(as_bytes(F.col(text_col)).alias("raw")).mapInArrow(run, "w binary, g int, n bigint").groupBy("w", "g").agg(F.sum("n").alias("n"))


def _frequent(vocab: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `most`, down to a power of 2 ** (1 / 16), most frequent first."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes, taken, least = vocab.groupBy(level.alias("k")).count().collect(), 0, None  # a few hundred rows
    for k, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        if taken + n > most:
            break
        taken, least = taken + n, k
    if least is None:
        return []
    rows = vocab.where(level >= least).select("w", "n").toPandas()
    return sorted(zip(map(bytes, rows.w), map(int, rows.n), strict=True), key=lambda r: (-r[1], r[0]))


def transitions(docs: DataFrame, units: dict[bytes, int], n_units: int, text_col="text") -> np.ndarray:
    """How often each unit follows each unit (a text starts after an end), over all docs: a matrix of fixed size."""
    spark = docs.sparkSession
    shared, base = spark.sparkContext.broadcast(units), n_units - GROUPS

    def run(batches):
        get, groups, end = shared.value.get, _Groups(), shared.value[END]
        total = np.zeros(n_units * n_units, np.int64)
        for b in slices(batches):
            ids = [end]
            for raw in b.column(0).to_pylist():
                ids += [u if (u := get(w)) is not None else base + groups[w[-3:]] for w in _tokens(raw)]
            a = np.array(ids, np.int64)
            total += np.bincount(a[:-1] * n_units + a[1:], minlength=n_units * n_units)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["code", "n"])

    sums = docs.select(as_bytes(F.col(text_col)).alias("raw")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_units * n_units)
    out[sums.code.to_numpy(np.int64)] = sums.n.to_numpy(np.float64)
    return out.reshape(n_units, n_units)


def exchange(follows: np.ndarray, n_classes: int = CLASSES, sweeps: int = MOST_SWEEPS) -> np.ndarray:
    """The class of each unit: exchange clustering for the likelihood of the class bigrams."""
    n = len(follows)
    weight = follows.sum(axis=0) + follows.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(n) % n_classes
    member = np.eye(n_classes)[cls]
    g = member.T @ follows @ member

    f = _f
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            self_n, a = follows[u, u], cls[u]
            out = np.bincount(cls, follows[u], n_classes)
            into = np.bincount(cls, follows[:, u], n_classes)
            out[a] -= self_n
            into[a] -= self_n
            g[a, :] -= out
            g[:, a] -= into
            g[a, a] -= self_n
            rows, cols = g.sum(axis=1) + into, g.sum(axis=0) + out  # what u takes and gives counts in the other classes' margins, wherever it goes
            d = np.diag(g)
            gain = (f(g + out) - f(g)).sum(axis=1) + (f(g.T + into) - f(g.T)).sum(axis=1)
            gain += f(d + out + into + self_n) - f(d + out) - f(d + into) + f(d)
            n_out, n_in = out.sum() + self_n, into.sum() + self_n
            gain -= f(rows + n_out) - f(rows) + f(cols + n_in) - f(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            cls[u] = b
            moved += b != a
            g[b, :] += out
            g[:, b] += into
            g[b, b] += self_n
        if not moved:
            break
    return cls


def learn_core(docs: DataFrame, text_col="text") -> dict:
    """Vocabulary, frequent words, and the classes of units: frequent words one by one, all others by ending."""
    vocab = materialize(count_words(docs, text_col), "vocabulary")
    ends = vocab.where(F.length("w") == 0).agg(F.sum("n")).first()[0] or 0
    frequent = [(w, n) for w, n in _frequent(vocab, FREQUENT) if w]
    top = [END, *(w for w, _ in frequent[: TOP - 1])]
    follows = transitions(docs, {w: i for i, w in enumerate(top)}, len(top) + GROUPS, text_col) if ends else np.zeros((len(top) + GROUPS,) * 2)
    cls, group = exchange(follows), _Groups()
    words = [END, *(w for w, _ in frequent)]
    classes = np.array([cls[i] if i < len(top) else cls[len(top) + group[w[-3:]]] for i, w in enumerate(words)], np.int64)
    member = np.eye(CLASSES)[cls]
    return {"vocab": vocab, "follows": member.T @ follows @ member, "words": words, "counts": np.array([ends, *(n for _, n in frequent)], np.int64), "classes": classes, "by_group": cls[len(top) :], "n_top": len(top)}


def encode(docs: DataFrame, core: dict, keep: dict[str, Column], text_col="text") -> DataFrame:
    """The columns of keep as _keep0 and so on, with _key, _seq, _rare and _first of each text, in the shared folder.

    _seq: little-endian int32 of each token, the number of a frequent word, or -1 - i for the i-th of the text's other
    words, which are in _rare; _first: the classes of their endings.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [f"_keep{i}" for i in range(len(keep))]
    cols = docs.select(*[c.alias(n) for n, c in zip(names, keep.values(), strict=True)], as_bytes(F.col(text_col)).alias("_raw"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema.fields[:-1])
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(core["words"])}, core["by_group"].tolist()))  # at most FREQUENT words

    def run(batches):
        (number, by_group), groups = shared.value, _Groups()
        get, key = number.get, TaskContext.get().partitionId() << 33
        for b in slices(batches):
            seqs, rares = [], []
            for raw in b.column(b.num_columns - 1).to_pylist():
                tokens, rare = _tokens(raw), {}
                ids = [i if (i := get(w)) is not None else rare.setdefault(w, -1 - len(rare)) for w in tokens]
                seqs.append(np.array(ids, "<i4").tobytes())
                rares.append(list(rare))
            first = [[by_group[groups[w[-3:]]] for w in r] for r in rares]
            keys = pa.array(range(key, key + len(seqs)), pa.int64())
            key += len(seqs)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], keys, pa.array(seqs, pa.binary()), pa.array(rares, pa.list_(pa.binary())), pa.array(first, pa.list_(pa.int16()))], names=[*names, "_key", "_seq", "_rare", "_first"])

    return materialize(cols.mapInArrow(run, f"{schema}_key bigint, _seq binary, _rare array<binary>, _first array<smallint>"), "encoded")


def _flat(seqs: pa.Array, rare_sizes: np.ndarray, n_words: int) -> np.ndarray:
    """The tokens of several texts in a row, after an end: numbers of frequent words, then places in the texts' rare words."""
    parts = [np.frombuffer(x, "<i4") for x in seqs.to_pylist()]
    ids = np.concatenate([np.zeros(1, np.int64), *parts]).astype(np.int64)
    start = n_words + np.cumsum(rare_sizes) - rare_sizes
    shift = np.concatenate([np.zeros(1, np.int64), np.repeat(start, [len(p) for p in parts])])
    return np.where(ids < 0, shift - 1 - ids, ids)


def _packed(who: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The distinct values of who (ascending), and lists of their codes and counts."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(who)), bool), who[1:] != who[:-1]]))
    offsets = pa.array(np.append(at, len(who)), pa.int32())
    return who[at], pa.ListArray.from_arrays(offsets, pa.array(code, pa.int16())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))


def neighbours(encoded: DataFrame, core: dict) -> DataFrame:
    """(i, w, part, codes, ns): how often each word has a word of class code before it, or of class code - CLASSES after it; a row a word and task or so (part), for words that may still move.

    Frequent words are known by their number i, others by w.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(core["classes"])
    names, step, n_top = ["i", "w", "part", "codes", "ns"], 2 * CLASSES, core["n_top"]

    def run(batches):
        frequent, part = shared.value, TaskContext.get().partitionId()
        n_words, held, size = len(frequent), [], 0

        def merged():
            codes, ns = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(codes, kind="stable")
            codes, ns = codes[order], ns[order]
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
            return codes[at], np.add.reduceat(ns, at) if len(at) else ns

        def rows(codes, ns):
            i, c, n = _packed(codes // step, codes % step, ns)
            out = pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.nulls(len(i), pa.binary()), pa.array(np.full(len(i), part), pa.int32()), c, n], names=names)
            for k in range(0, len(i), 20_000):
                yield out.slice(k, 20_000)

        for b in slices(batches, 4000):
            first, rare = b.column(2), b.column(1)
            sizes = rare.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = _flat(b.column(0), sizes, n_words)
            cls = np.concatenate([frequent, first.flatten().to_numpy(zero_copy_only=False)])[x].astype(np.int64)
            words = rare.flatten().dictionary_encode()
            x = np.where(x < n_words, x, n_words + np.append(words.indices.to_numpy(zero_copy_only=False), 0)[np.maximum(x - n_words, 0)])
            codes, ns = np.unique(np.concatenate([x[1:] * step + cls[:-1], x[:-1] * step + CLASSES + cls[1:]]), return_counts=True)
            cut = np.searchsorted(codes, n_words * step)
            w, c, n = _packed(codes[cut:] // step - n_words, codes[cut:] % step, ns[cut:])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int32()), words.dictionary.take(pa.array(w)), pa.array(np.full(len(w), part), pa.int32()), c, n], names=names)
            fixed = np.searchsorted(codes, n_top * step)  # of words that stay in their classes
            held.append((codes[fixed:cut], ns[fixed:cut]))
            size += cut - fixed
            if size > 4_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*merged())

    return encoded.select("_seq", "_rare", "_first").mapInArrow(run, "i int, w binary, part int, codes array<smallint>, ns array<int>")


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n) of lists of (codes, ns), each row's code once, in order."""
    inner = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    codes, ns = inner.field(0), inner.field(1)
    row = np.repeat(row, codes.value_lengths().to_numpy(zero_copy_only=False))
    key, at = np.unique(row * (2 * CLASSES) + codes.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    return key // (2 * CLASSES), key % (2 * CLASSES), np.bincount(at, ns.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)


def gathered(each: DataFrame, tasks: int) -> DataFrame:
    """(i, w, p): each word's lists of neighbours, summed in a tree of FAN tasks a node, so that no row gathers what grows with the number of tasks."""

    def run(batches):
        for b in slices(batches, 20_000):
            row, code, n = _entries(b.column(3))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(code, pa.int16())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], names=["i", "w", "part", "codes", "ns"])

    lists = F.collect_list(F.struct("codes", "ns")).alias("p")  # at most 2 * CLASSES entries a word and task, or so
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        each = each.groupBy("i", "w", F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(lists).mapInArrow(run, "i int, w binary, part int, codes array<smallint>, ns array<int>")
    return each.groupBy("i", "w").agg(lists)


def _f(x):
    return x * np.log(np.maximum(x, 1))


def best_classes(present: np.ndarray, owner: np.ndarray, code: np.ndarray, n: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The class of each word in which the likelihood is largest, all other words staying where they are.

    present: the words' classes; (owner, code, n): their neighbours' counts, each (owner, code) once; g: transitions between classes.
    """
    size, at = len(present), np.arange(len(present))
    table = np.vstack([g, g.T])  # row code, column class: the transitions that a neighbour of this code adds to
    gain, stay = np.zeros((size, CLASSES)), np.zeros(size)
    own = table[code, present[owner]]
    stay += np.bincount(owner, _f(own) - _f(np.maximum(own - n, 0)), size)
    for k in range(1, 5):  # small counts, nearly all: a matrix product for each
        s = n == k
        one = np.zeros((size, 2 * CLASSES), np.float32)
        one[owner[s], code[s]] = 1
        gain += one @ (_f(table + k) - _f(table))
    s = np.flatnonzero(n > 4)
    for part in np.array_split(s, len(s) // 50_000 + 1):
        if len(part):
            who, m = owner[part], n[part][:, None]
            cell = table[code[part]]
            starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            gain[who[starts]] += np.add.reduceat(_f(cell + m) - _f(cell), starts, axis=0)
    for total, side in ((g.sum(axis=0), code < CLASSES), (g.sum(axis=1), code >= CLASSES)):
        k = np.bincount(owner[side], n[side], size)
        gain -= _f(total[None, :] + k[:, None]) - _f(total)[None, :]
        stay -= _f(total[present]) - _f(np.maximum(total[present] - k, 0))
    gain[at, present] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[at, best] > stay + 1e-9, best, present)


def learn_classes(encoded: DataFrame, core: dict) -> dict:
    """The model: each word of the training texts moves to the class that its own neighbours ask for; encoded: training texts."""
    spark, vocab = encoded.sparkSession, core["vocab"]
    shared = spark.sparkContext.broadcast((core["classes"], core["by_group"], core["follows"]))

    def run(batches):
        (frequent, by_group, g), groups = shared.value, _Groups()
        for b in slices(batches, 20_000):
            i = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            w = b.column(1).to_pylist()
            present = np.array([frequent[k] if x is None else by_group[groups[x[-3:]]] for k, x in zip(i, w, strict=True)], np.int64)
            row, code, n = _entries(b.column(2))
            best = best_classes(present, row, code, n, g)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32())], names=["i", "w", "cls"])

    each = gathered(neighbours(encoded, core), encoded.rdd.getNumPartitions())
    moved = materialize(each.mapInArrow(run, "i int, w binary, cls int"), "classes")
    classes, counts = core["classes"].copy(), core["counts"]
    for r in moved.where("i is not null").select("i", "cls").toPandas().itertuples():  # at most FREQUENT rows
        classes[r.i] = r.cls
    rare = materialize(moved.where("i is null").select("w", "cls").join(vocab.select("w", "n"), "w"), "rare-words")
    tokens, words = np.bincount(classes, counts, CLASSES), np.bincount(classes[counts > 0], minlength=CLASSES).astype(np.float64)
    for r in rare.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows
        tokens[r.cls] += r.n
        words[r.cls] += r.v
    return core | {"classes": classes, "rare": rare, "tokens": tokens, "kinds": words, "n": int(tokens.sum()), "v": int(words.sum())}


def with_classes(encoded: DataFrame, model: dict) -> DataFrame:
    """encoded, with _at, _n and _cls: which of a text's rare words are known, how often they occur, and their classes."""
    one = encoded.select("_key", F.posexplode("_rare").alias("at", "w")).join(model["rare"], "w")
    known = one.groupBy("_key").agg(F.collect_list(F.struct("at", "n", "cls")).alias("k"))  # words of one text
    return materialize(encoded.drop("_rare").join(known, "_key", "left").select(*[c for c in encoded.columns if c != "_rare"], F.col("k.at").alias("_at"), F.col("k.n").alias("_n"), F.col("k.cls").alias("_cls")), "classed")


def _filled(b: pa.RecordBatch, names: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a batch's texts in a row, after an end: their classes, and their counts if they are rare; and how many tokens each text has."""
    column = {n: b.column(names.index(n)) for n in ("_seq", "_first", "_at", "_n", "_cls")}
    sizes = column["_first"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    cls, n = column["_first"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(sizes.sum(), np.int64)
    found = np.nan_to_num(column["_at"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, found) + column["_at"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cls[at], n[at] = column["_cls"].flatten().to_numpy(zero_copy_only=False), column["_n"].flatten().to_numpy(zero_copy_only=False)
    x = _flat(column["_seq"], sizes, len(classes))
    lengths = np.array([len(s) // 4 for s in column["_seq"].to_pylist()], np.int64)
    return x, np.concatenate([classes, cls])[x], np.where(x >= len(classes), np.concatenate([np.zeros(len(classes), np.int64), n])[x], -1), lengths


_CLASSED = ["_seq", "_first", "_at", "_n", "_cls"]


def learn_transitions(classed: DataFrame, model: dict) -> dict:
    """The model with its transitions, from training texts."""
    shared = classed.sparkSession.sparkContext.broadcast(model["classes"])

    def run(batches):
        g = np.zeros(CLASSES * CLASSES, np.int64)
        for b in slices(batches):
            _, cls, _, _ = _filled(b, _CLASSED, shared.value)
            g += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(g[at], pa.int64())], names=["code", "n"])

    g = np.zeros(CLASSES * CLASSES)
    for r in classed.select(*_CLASSED).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():  # CLASSES * CLASSES rows
        g[r.code] = r.n
    trans, denom = _logs(g.reshape(CLASSES, CLASSES), model["tokens"], model["kinds"])
    return model | {"follows": g.reshape(CLASSES, CLASSES), "log_transitions": trans, "log_denominators": denom}


def _logs(g: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p(class | previous class), and log10 of each class's emission denominator."""
    share = (tokens + 1e-6) / (tokens + 1e-6).sum()
    return np.log10((g + KAPPA * share) / (g.sum(axis=1, keepdims=True) + KAPPA)), np.log10(tokens + words + 1)


def score(classed: DataFrame, model: dict, keep: dict[str, Column]) -> DataFrame:
    """The columns of keep (by name), with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    names = [f"_keep{i}" for i in range(len(keep))]
    shared = classed.sparkSession.sparkContext.broadcast((model["classes"], model["counts"], model["log_transitions"], model["log_denominators"]))
    per_token = math.log10(model["n"] + model["v"] + 1)
    cols = classed.select(*names, *_CLASSED)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema.fields[: len(names)])

    def run(batches):
        classes, counts, trans, denom = shared.value
        for b in slices(batches):
            x, cls, n, lengths = _filled(b, [*names, *_CLASSED], classes)
            n = np.where(n >= 0, n, np.concatenate([counts, [0]])[np.minimum(x, len(counts))])[1:]
            logs, starts = np.log10(n + 1.0), np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(v, starts) for v in (n > 0, logs, trans[cls[:-1], cls[1:]] - denom[cls[1:]])] if len(lengths) else [[]] * 3
            base = sums[1] - lengths * per_token if len(lengths) else []
            total = sums[1] + sums[2] if len(lengths) else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lengths, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())], names=[*names, "n_tokens", "n_known", "base_score", "score"])

    out = cols.mapInArrow(run, f"{schema}n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def train_and_score(docs: DataFrame, learn: Column, keep: dict[str, Column], text_col="text") -> tuple[DataFrame, dict]:
    """score() of all docs by a model of those where learn is true, and the model."""
    core = learn_core(docs.where(learn), text_col)
    encoded = encode(docs, core, keep | {"": F.coalesce(learn, F.lit(False))}, text_col)
    mark = f"_keep{len(keep)}"
    classed = with_classes(encoded, model := learn_classes(encoded.where(mark), core))
    model = learn_transitions(classed.where(mark), model)
    return score(classed, model, keep), model


def query(spark, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    return train_and_score(read_table(spark, sf_dir, "documents"), ~held_out, {"doc_id": F.col("doc_id"), "held_out": held_out})[0]

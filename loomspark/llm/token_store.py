"""Token ids in binary shards, compressed by a grammar.

A shard holds the ids of consecutive documents. Re-Pair: the pairs of neighbouring symbols that occur often are
replaced by new symbols, in ROUNDS rounds that replace many pairs at once (`compress` takes any number; it ends when no pair is
frequent enough); of overlapping places, every second one is replaced. The shard stores the rules, each rule's
expansion length, and the remaining symbols, so that any range of ids can be decoded without the rest: a running
sum of expansion lengths finds the symbols that cover it.

Shards are rows of a Parquet table: a blob in the format below, and the header of its documents beside it. Files are
in ascending order of document id: the table is range-partitioned and sorted, and a shard ends after SHARD ids.

Blob, little-endian: b"RPG1", three uint32 (first rule's id, number of rules, number of symbols), rules as pairs of
uint32, expansion lengths as uint32, symbols as uint32.

Ids of documents are whole numbers. Files whose way of preparing texts isn't the one that the word-by-word encoder
stands for are encoded by their own tokenizer as it is.

Edge cases: null texts are empty and have the end id only; null ids come first; rows of one id go by the hash
of their texts, so that reruns agree; repeated rows are separate documents; an empty table gives no shard. Texts are used whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import chain
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, ship, slices

END = 2
FIRST_RULE = 1 << 20
SHARD = 1 << 20
ROUNDS = 3
LEAST_COUNT = 4
MOST_RULES_A_ROUND = 1 << 15
CACHE = 300_000
STOPS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # not those of apostrophe forms and special tokens
SIGMA = "\u03a3"  # the one letter whose lower case depends on its neighbours
MAGIC = b"RPG1"


def _replace(seq: np.ndarray, first: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the new symbols, and the pairs that were replaced (as left << 32 | right), whose ids count from first."""
    codes = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(counts >= least)
    if len(often) > most:
        often = np.sort(often[np.argsort(-counts[often], kind="stable")[:most]])
    chosen = ordered[starts[often]]
    if not len(chosen):
        return seq, chosen
    left = np.zeros(first, bool)
    right = np.zeros(first, bool)
    left[(chosen >> np.uint64(32)).astype(np.int64)] = True
    right[(chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(left[seq[:-1]] & right[seq[1:]])
    own = codes[at]
    rule = np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)
    hit = chosen[rule] == own
    at, rule = at[hit], rule[hit]
    new_run = np.concatenate([[True], np.diff(at) != 1])
    run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
    use = (np.arange(len(at)) - run_start) % 2 == 0
    at, rule = at[use], rule[use]
    used = np.bincount(rule, minlength=len(chosen)) > 0
    out = seq.copy()
    out[at] = first + (np.cumsum(used) - 1)[rule]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep], chosen[used]


def compress(ids: np.ndarray, rounds: int = ROUNDS, least: int = LEAST_COUNT, most: int = MOST_RULES_A_ROUND) -> bytes:
    """The blob of a shard with these ids (below FIRST_RULE)."""
    seq, rules = ids.astype(np.uint32), []
    lengths = [np.ones(0, np.uint32)]
    size = np.ones(FIRST_RULE, np.uint32)
    for _ in range(rounds):
        first = FIRST_RULE + sum(map(len, rules))
        if len(seq) < 2 * least:
            break
        shorter, pairs = _replace(seq, first, least, most)
        if not len(pairs):
            break
        own = size[(pairs >> np.uint64(32)).astype(np.int64)] + size[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        size = np.concatenate([size, own])
        rules.append(pairs)
        lengths.append(own)
        little = len(seq) - len(shorter) < len(seq) // 100
        seq = shorter
        if little:
            break
    pairs = np.concatenate([*rules, np.zeros(0, np.uint64)])
    table = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype("<u4")
    return MAGIC + struct.pack("<III", FIRST_RULE, len(pairs), len(seq)) + table.tobytes() + np.concatenate(lengths).astype("<u4").tobytes() + seq.astype("<u4").tobytes()


def _parts(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    if blob[:4] != MAGIC:
        raise ValueError("not a shard")
    first, n, m = struct.unpack_from("<III", blob, 4)
    rules = np.frombuffer(blob, "<u4", 2 * n, 16).reshape(n, 2)
    return first, rules, np.frombuffer(blob, "<u4", n, 16 + 8 * n), np.frombuffer(blob, "<u4", m, 16 + 12 * n)


def _expand(seq: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    while True:
        is_rule = seq >= first
        if not is_rule.any():
            return seq
        place = np.cumsum(1 + is_rule) - 1  # of the last symbol each one becomes
        out = np.empty(place[-1] + 1, np.uint32)
        out[place[~is_rule]] = seq[~is_rule]
        own = rules[seq[is_rule] - first]
        out[place[is_rule] - 1], out[place[is_rule]] = own[:, 0], own[:, 1]
        seq = out


def decompress(blob: bytes) -> np.ndarray:
    """All ids of a shard."""
    first, rules, _, seq = _parts(blob)
    return _expand(seq, first, rules)


def read_range(blob: bytes, start: int, n: int) -> np.ndarray:
    """ids[start : start + n] of a shard; only the symbols that cover them are expanded."""
    first, rules, lengths, seq = _parts(blob)
    if n <= 0 or not len(seq):
        return np.zeros(0, np.uint32)
    is_rule = seq >= first
    size = np.ones(len(seq), np.int64)
    size[is_rule] = lengths[seq[is_rule] - first]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left")
    skip = start - (ends[a - 1] if a else 0)
    return _expand(seq[a : b + 1], first, rules)[skip : skip + n]


#: How a file must prepare texts for words to be encoded one by one: its normalizer, pre-tokenizer and added tokens.
WORD_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "added": ["<|endoftext|>", "<|startoftext|>"],
}


def goes_word_by_word(path: str) -> bool:
    """Whether a tokenizers file is a BPE model that prepares texts in the one way that Encoder's short cuts stand for."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    same = all(d.get(k) == WORD_BY_WORD[k] for k in ("normalizer", "pre_tokenizer")) and sorted(t["content"] for t in d.get("added_tokens", [])) == WORD_BY_WORD["added"]
    return same and d["model"]["type"] == "BPE" and not d["model"].get("dropout") and d.get("truncation") is None and d.get("padding") is None and d.get("post_processor") is None


class PlainEncoder:
    """Encodes texts with any tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and where each text's end."""
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)


class Encoder:
    """Encodes texts with a tokenizers file whose pre-tokens never cross a space, and are runs of letters, or of other marks.

    The pieces between spaces are told apart once a batch, and their ids put in the order of the texts. A piece that is
    letters and then stops is the letters' ids and the stops'; the ids of letters are kept by their lower case. New ones
    that are ASCII go straight to the file's BPE model, as lower case and bytes are all that the file's other parts look
    at in them; others are encoded together, space between.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.letters = Tokenizer.from_file(path), {}, {}
        self.ends: dict[str, bytes] = {}
        self.split_letters = self.tokenizer.model.tokenize
        self.id_bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_letters(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, at = np.array(e.ids, "<u4"), np.array(e.word_ids)
            ends = np.flatnonzero(np.append(np.diff(at), 1)) + 1
            if len(ends) == len(some) and len(at) and at[-1] == len(some) - 1:
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                self.letters.update(zip(some, (raw[x:y] for x, y in zip([0, *stops], stops, strict=False)), strict=True))
            else:  # a run of letters that is more than one pre-token
                self.letters.update(zip(some, self._alone(some), strict=True))

    def _other_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are not ASCII letters and stops."""
        known, ends, other, plain = self.pieces, self.ends, [], []
        for p in pieces:
            if p in known:
                continue
            core = p.rstrip(STOPS)
            if core.isalpha() and SIGMA not in core:
                plain.append((p, core.lower(), p[len(core) :]))
            else:
                other.append(p)
        known.update(zip(other, self._alone(other), strict=True))
        self._learn_letters(list({low for _, low, _ in plain}.difference(self.letters)))
        self._learn_ends({end for _, _, end in plain})
        for p, low, end in plain:
            known[p] = self.letters[low] + ends[end]
        return [known[p] for p in pieces]

    def _learn_ends(self, ends: set[str]) -> None:
        new = list(ends.difference(self.ends))
        self.ends.update(zip(new, self._alone(new), strict=True))

    def _ascii_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case ASCII letters."""
        letters, tokenize, id_bytes, out = self.letters, self.split_letters, self.id_bytes, []
        for w in words:
            ids = letters.get(w)
            if ids is None:
                letters[w] = ids = b"".join([id_bytes[t.id] for t in tokenize(w)])
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and where each text's end."""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(self.letters) > CACHE:
            self.letters.clear()
        if len(self.ends) > CACHE:
            self.ends.clear()
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary
        is_word = pc.and_(pc.string_is_ascii(distinct), pc.ascii_is_alpha(pc.ascii_rtrim(distinct, STOPS)))
        found = distinct.filter(is_word)
        words = pc.ascii_lower(pc.ascii_rtrim(found, STOPS)).dictionary_encode()
        stops = pc.ascii_ltrim(found, ascii_letters).dictionary_encode()
        self._learn_ends(set(_strings(stops.dictionary)))
        parts = [self._ascii_words(_strings(words.dictionary)), [self.ends[e] for e in _strings(stops.dictionary)], self._other_pieces(_strings(distinct.filter(pc.invert(is_word)))), [b""]]
        at = np.cumsum([0, *map(len, parts)])
        mask = is_word.to_numpy(zero_copy_only=False)
        halves = np.full((len(distinct), 2), at[3])  # a word and its stops, or another piece and nothing
        halves[mask, 0], halves[mask, 1] = words.indices.to_numpy(), at[1] + stops.indices.to_numpy()
        halves[~mask, 0] = np.arange(at[2], at[3])
        raw = list(chain.from_iterable(parts))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = _take(np.frombuffer(b"".join(raw), "<u4"), sizes, halves.ravel())
        sizes = sizes[halves].sum(axis=1)
        order = pieces.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[order])])[split.offsets.to_numpy()[1:]]
        return _take(ids, sizes, order), ends

    def __call__(self, texts: list) -> list[bytes]:
        """The little-endian uint32 ids of each text."""
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])] if len(ends) else []


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _take(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of these sizes that values is made of, in this order."""
    starts, own = np.cumsum(sizes) - sizes, sizes[order]
    shift = starts[order] - (np.cumsum(own) - own)
    return values[np.repeat(shift, own) + np.arange(own.sum())]


_encoders: dict[str, Encoder | PlainEncoder] = {}


def _encoder(path: str) -> Encoder | PlainEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path) if goes_word_by_word(path) else PlainEncoder(path)
    return _encoders[path]


def encode_shards(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", end: int = END, shard: int = SHARD) -> DataFrame:
    """(part, seq, first_id, n_tokens, doc_ids, lengths, blob): the shards, ordered by part and seq."""
    ship(docs.sparkSession)
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]  # an id of very many rows is dealt over ranges, too
    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["part", "seq", "n_tokens", "doc_ids", "lengths", "blob"]

    def run(batches):
        encode, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, ids, lengths, n, last = [], [], [], 0, np.array([end], "<u4")

        def row():
            blob = compress(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=names)

        for b in slices(batches):
            found, ends = encode.encode(b.column(1).cast(pa.string()))
            start = 0
            for doc_id, stop in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                held += [found[start:stop], last]
                ids.append(doc_id)
                lengths.append(stop - start + 1)
                n, start = n + lengths[-1], stop
                if n >= shard:
                    yield row()
                    held, ids, lengths, n, seq = [], [], [], 0, seq + 1
        if held:
            yield row()

    return ordered.mapInArrow(run, "part int, seq int, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, blob binary")


def read_shards(shards: DataFrame, id_col="doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the stored shards."""
    ship(shards.sparkSession)
    kinds = "id bigint, part int, seq int, local bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        for b in slices(batches, 8):
            for part, seq, ids, lengths, blob in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                raw = decompress(blob).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["id", "part", "seq", "local", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "seq", "doc_ids", "lengths", "blob").mapInArrow(run, kinds)
    # ids before each shard: by parts (as many as there are tasks), then by shards within a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("inner")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("offset"))
    return docs.join(offsets, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Write the shards to the shared folder, and return what the stored files say of each document."""
    return read_shards(materialize(encode_shards(docs, tokenizer, id_col, text_col), "token-shards"), id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return write_and_read(read_table(spark, sf_dir, "documents"), default_tokenizer())

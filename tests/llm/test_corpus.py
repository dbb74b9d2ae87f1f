"""The corpus operators against brute force, on rows with every edge the docstrings name."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import difference
from loomspark.llm import brown_lm, decontamination, language_id, license_scan, mixing, mpeg_audio, registry, simhash, token_store, toxicity, wrapper

SF = "/root/testdata/sf0.001"
LONG = "word salad of no meaning " * 20000
TEXTS = [None, "", "   ", "\t\n", "É", "123 456", "one", "one two", "a b c d e f g h i j k l m n o p", "Zeta A b C d e f g h i j k l m", LONG, LONG, LONG + " end", "the MIT License and the Apache license", "mit license mit license", "你好。", "x<|endoftext|>y don't"]
WORD, SPACED = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "s", "t"][i % 3], 7, 0.5) for i, t in enumerate(TEXTS)]
    rows.append(rows[8])  # a row repeated in full
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, score double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def raw(t):
    return (t or "").encode().lower()


def test_decontamination_equals_sql_and_brute_force(spark, docs, none):
    assert difference(spark, SF, registry.queries()["op2_decontamination"], decontamination.SQL) is None
    bench = spark.createDataFrame([(1, "B c d e f g h i j k l m n and more"), (2, "one two"), (3, None), (4, "!!"), (5, "b c d e f g h i j k l m n"), (6, "word"), (6, "word")], "item_id bigint, text string")
    items = {(i, tuple(w[s : s + min(13, len(w))])) for i, t in [tuple(r) for r in bench.collect()] if (w := WORD.findall(raw(t))) for s in range(len(w) - min(13, len(w)) + 1)}
    for limit in (10**6, 0):  # broadcast, and joined by a shuffle
        got = {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.find_overlaps(docs, bench, max_broadcast_rows=limit).collect()}
        assert len(got) == len(TEXTS)
        for d, t in enumerate(TEXTS):
            w, hit, ids = WORD.findall(raw(t)), set(), set()
            for i, win in items:
                for s in range(len(w) - len(win) + 1) if len(w) < 1000 or len(win) == 1 else []:
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(i)
            assert got[d] == (len(w), len(hit), tuple(sorted(ids)))
    assert decontamination.find_overlaps(none, bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_rows_that_repeat(spark):
    rows = [(1, "one two three"), (None, None), (None, "one two")] * 3 + [(1, "one"), (2, "one two three")] + [(7, "two")] * 20_001
    df = spark.createDataFrame(rows, "doc_id int, text string")
    bench = spark.createDataFrame([(5, "two"), (6, "nine")], "item_id int, text string")
    for limit in (0, 100):
        got = decontamination.per_document(decontamination.find_overlaps(df, bench), df, max_broadcast_rows=limit)
        assert got.columns == ["doc_id", "text_hash", "n_words", "n_hit", "items"]
        want = {(1, 3, 1): 3, (None, 0, 0): 3, (None, 2, 1): 3, (1, 1, 0): 1, (2, 3, 1): 1, (7, 1, 1): 20_001}
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit) for r in got.collect()) == want


def test_decontamination_of_short_items_and_periodic_texts(spark):
    rng = np.random.default_rng(11)
    texts = ["yes yes yes", "the cat the dog the man sat", " ".join(["a b c"] * 30), "z " * 60, " ".join("p%d" % (i % 9) for i in range(80)), " ".join("q%d" % (i % 10) for i in range(80))]
    texts += [" ".join(rng.choice(list("abc"), rng.integers(1, 80))) for _ in range(60)] + [" ".join([*"xyzuvw"[: i + 1]] * 12 + ["end", "of", "it"]) for i in range(6)]
    items = ["yes", "the man sat", "the dog", "a b c a", "z " * 13, " ".join("p%d" % (i % 9) for i in range(3, 20)), " ".join("q%d" % (i % 10) for i in range(5, 18)), "c a b c a b c a b c a b c a b"]
    items += [" ".join(rng.choice(list("abc"), n)) for n in (2, 3, 4, 5, 6)] + [" ".join(([*"xyzuvw"[: i + 1]] * 12 + ["end", "of", "it"])[-13:]) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.find_overlaps(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), bench).collect()}
    for d, t in enumerate(texts):
        w, hit, ids = t.split(), set(), set()
        for i, item in enumerate(items):
            x = item.split()
            n = min(13, len(x))
            wins = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    ids.add(i)
        assert got[d] == (len(hit), sorted(ids)), t


def components(fps):
    part = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    return part


def test_simhash_groups_equal_brute_force(spark, docs, none):
    def fingerprint(t):
        w = SPACED.findall(raw(t))
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if len(h) < 50000 else None

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    own = {r.doc_id: r.fp & (1 << 64) - 1 for r in got}
    assert all(own[i] == f for i, t in enumerate(TEXTS) if (f := fingerprint(t)) is not None)
    want = components([own[i] for i in range(len(TEXTS))])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert simhash.near_duplicates(none).count() == 0


def test_near_links_lose_no_pair_in_crowded_cells(spark):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 2**64, 60, np.uint64).tolist())
    for f in list(fps)[:12]:
        for _ in range(40):
            f ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(f)
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    links = simhash.near_links(table, piece=16)  # cells are cut into pieces
    part = {r.node: r.component for r in simhash.connected_components(links).collect()}
    assert [part.get(i, i) for i in range(len(fps))] == components(fps)


def test_mixing_meets_targets(spark, docs, none):
    for df in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = mixing.mix(df).toPandas()
        again = mixing.mix(df.repartition(5)).toPandas()
        assert len(got) == df.count() and (got.taken <= 2 * got["size"]).all()
        key = ["doc_id", "size", "taken"]
        assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
        per = got.assign(source=got.source.fillna("￿")).groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
        assert (per["size"] == per.own).all() and (per.target <= 2 * per.own + 1e-6).all() and (abs(per.taken - per.target) <= 1).all()
        want, left, weights = {}, 1.5 * per.own.sum(), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per.index))}
        while weights:  # cut at twice the size, and share again
            over = [s for s, w in weights.items() if left * w / sum(weights.values()) > 2 * per.own[s]]
            if not over:
                want |= {s: left * w / sum(weights.values()) for s, w in weights.items()}
                break
            for s in over:
                want[s] = 2.0 * per.own[s]
            left -= sum(want[s] for s in over)
            weights = {s: w for s, w in weights.items() if s not in over}
        assert all(abs(per.target[s] - t) < 1e-3 for s, t in want.items())
    assert mixing.mix(none).count() == 0


def test_mixing_meets_targets_of_small_sources_in_large_blocks(spark):
    sizes = {"a": [400] * 100, "b": [3], "c": [7, 0, 5], "d": [100] * 3, "e": [1] * 20, "f": [900], None: [50, 60]}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    for slots in (1, 8, 100, 1 << 18):
        got = mixing.mix(df, slots=slots).toPandas()
        per = got.assign(source=got.source.fillna("-")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
        assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (per.taken == per.target.round()).all(), slots
    shares = mixing.targets(spark.createDataFrame([(n, s) for s, ns in sizes.items() for n in ns], "size bigint, source string"))
    plan, target = mixing.schedule(shares, 300).toPandas().sort_values(["at", "k"]), {r.k: r.target for r in shares.collect()}
    for k, t in target.items():  # every prefix is close to the targets
        own = plan.words.where(plan.k == k, 0).cumsum()
        assert (abs(own - t * plan["at"]) <= 2 * 300 + 1).all() and own.iloc[-1] == round(t)


def test_slots_fall_to_sources_by_golden_ratio_points(spark):
    sizes = {"a": [400] * 100, "b": [3], "c": [7, 0, 5], "d": [100] * 3, "e": [1] * 20, "f": [900], None: [50, 60]}
    shares = mixing.targets(spark.createDataFrame([(n, s) for s, ns in sizes.items() for n in ns], "size bigint, source string"))
    plan = mixing.schedule(shares, 30).toPandas().sort_values("slot")
    needs = plan.groupby("k").size()
    owner = [k for k, n in needs.items() for _ in range(n)]  # of each place of the unit interval
    step, size = mixing.lattice(len(owner))
    assert abs(step / size - 0.6180339887498949) < 1 / size and plan.slot.is_unique and plan.slot.between(0, size - 1).all()
    want = [(i, owner[i * step % size]) for i in range(size) if i * step % size < len(owner)]
    assert list(zip(plan.slot, plan.k)) == want
    assert (plan.groupby("k").cumcount() == plan["rank"]).all()  # blocks are taken in the order of the schedule
    for k, n in needs.items():
        assert (abs((plan.k == k).cumsum() - (plan.slot + 1) * n / size) < 4).all()
    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)], "doc_id int, text string, source string")
    got = mixing.mix(df, slots=1000).toPandas()
    assert (got.first_slot.isna() == (got.taken == 0)).all() and got.groupby("source", dropna=False).first_slot.min().is_unique


def test_token_shards_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    t, at = Tokenizer.from_file(path), 0
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.write_and_read(docs, path).collect())
    for row, text in zip(got, sorted([*enumerate(TEXTS), (8, TEXTS[8])], key=lambda d: d[0]), strict=True):
        ids = [*t.encode(text[1] or "", add_special_tokens=False).ids, 2]
        assert row == (text[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.write_and_read(none, path).count() == 0


def test_rows_of_one_id_keep_their_order(spark):
    rows = [(7, f"text {i} of one id") for i in range(300)] + [(None, f"no id {i}") for i in range(50)] + [(3, "first"), (9, "last"), (7, "text 4 of one id")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    runs = [sorted(map(tuple, token_store.write_and_read(df.repartition(n), token_store.default_tokenizer()).collect()), key=lambda r: r[1]) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert [r[0] for r in runs[0]] == [None] * 50 + [3] + [7] * 301 + [9]


def test_encoder_equals_tokenizer_on_odd_texts():
    path = token_store.default_tokenizer()
    encode = token_store.Encoder(path)
    texts = ["mIt MIT. mit", "a" * 5000 + " x" * 3, "É Éa e\u0301. K\u212a", "ΣΑΣ. ΣΑΣ", "don't I'LL, it's", "<|endoftext|> x<|startoftext|>", "\t a b\u00a0 c", "ﬁn ǅ İ ẞ", "日本語 テスト。", "", "  ", "\r\nend?! ...", "x;;:\x00a b", None]
    for _ in range(2):  # the second time from what is kept
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_equals_tokenizer_on_random_marks():
    encode, rng = token_store.Encoder(token_store.default_tokenizer()), np.random.default_rng(3)
    chars = list("abAB'sSnTt09 .,;:!?#*$%&_-<>|é ñΣß²½Ⅷ中\u0301\u200d\u00a0\t\n\x00\"\\`~^@/()[]{}=+")
    texts = ["".join(rng.choice(chars, rng.integers(0, 40))) for _ in range(5000)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encode([]) == []


def test_grammar_is_lossless_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([2]), np.full(1001, 7), np.tile([1, 2, 3], 500), rng.integers(0, 20, 5000), rng.integers(0, 1 << 20, 300)):
        blob = token_store.compress(ids.astype(np.uint32), rounds=6)
        assert token_store.decompress(blob).tolist() == ids.tolist()
        for s, n in ((0, 5), (len(ids) // 2, 17), (max(0, len(ids) - 3), 3)):
            assert token_store.read_range(blob, s, n).tolist() == ids[s : s + n].tolist()


def test_mpeg_payload_and_resync(spark, docs, none):
    got = mpeg_audio.describe(mpeg_audio.store_texts(docs)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        b = (TEXTS[r.doc_id] or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert "crc_bad=0;skipped=0" in r.feature and r.samples == 1152 * len(r.seek_offsets)
    assert mpeg_audio.describe(mpeg_audio.store_texts(none)).count() == 0
    media = mpeg_audio.write_audio(b"abc" * 3000)
    good = mpeg_audio.read_audio(media)
    assert good["duration"] == len(good["offsets"]) * mpeg_audio.Fraction(1152, 32000) and good["vbr"]["frames"] == len(good["offsets"])
    cut = good["offsets"][3]
    junk = mpeg_audio.read_audio(media[:cut] + b"\xff\xfb junk \xff\xff" + media[cut:] + b"TAG".ljust(128, b"\0"))
    assert len(junk["offsets"]) == len(good["offsets"]) and junk["skipped"] == 10
    bad = bytearray(media)
    bad[cut + 8] ^= 1
    assert mpeg_audio.read_audio(bytes(bad))["crc_bad"] == 1
    assert mpeg_audio.read_audio(b"no audio")["duration"] == 0
    for r in registry.queries()["op4_mpeg_audio"](spark, SF).collect():  # constant bits: frames lie one after the other, up to the end
        at = r.seek_offsets
        assert r.samples == 1152 * len(at) and r.hz == 32000 and all(a < b for a, b in zip(at, at[1:])) and 0 < at[0] <= at[-1] < r.media_bytes
        assert r.feature.endswith(f"seek={zlib.crc32(np.array(at, '<u4').tobytes()):08x}")


def test_mpeg_tag_inside_payload(spark):
    texts = ["x" * 29 + "TAG" + "y" * n for n in (33, 40, 60, 96)] + ["VINTAGE " * n for n in (9, 16, 100)] + [("TAG" * 900)[at:n] for at in range(3) for n in range(1, 2700, 61)]
    got = mpeg_audio.describe(mpeg_audio.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    for r in got:
        b = texts[r.doc_id].encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and "crc_bad=0;skipped=0" in r.feature
    assert len(got) == len(texts)
    media, tag = mpeg_audio.write_audio(b"x" * 2000), b"TAG" + b"Name".ljust(125, b"\0")
    n = len(mpeg_audio.read_audio(media)["offsets"])
    for data, frames, skipped in ((media + tag, n, 0), (media + b"junk" + tag, n, 4), (media[:-50] + tag, n - 1, None), (tag, 0, 0)):
        audio = mpeg_audio.read_audio(data)
        assert len(audio["offsets"]) == frames and audio["tags"]["TIT2"] == "Name" and skipped in (None, audio["skipped"])
    bare = spark.createDataFrame([(1, 8, bytearray(b"no audio"))], "doc_id int, n_bytes bigint, media binary")
    assert "frames=0;" in mpeg_audio.describe(bare).first().feature


def brown_rows(df, learn):
    rows, model = brown_lm.train_and_score(df, learn, {"doc_id": F.col("doc_id")})
    return rows.collect(), model


@pytest.mark.parametrize("frequent", [200_000, 20])
def test_brown_model_equals_brute_force(spark, docs, none, monkeypatch, frequent):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)  # few: most words come by the join
    monkeypatch.setattr(brown_lm, "TOP", 8)
    got, model = brown_rows(docs, F.col("doc_id") % 2 == 0)
    tokens = {i: [*SPACED.findall(raw(t)), b""] for i, t in enumerate(TEXTS)}
    rows = [*range(0, len(TEXTS), 2), 8]
    c = collections.Counter(w for i in rows for w in tokens[i])
    n, v = sum(c.values()), len(c)
    cls = dict(zip(model["words"], model["classes"].tolist(), strict=True)) | {bytes(r.w): r.cls for r in model["rare"].collect()}
    assert set(cls) - {b""} == set(c) - {b""}
    of = lambda w: cls[w] if w in cls else int(model["by_group"][zlib.crc32(w[-3:]) % brown_lm.GROUPS])
    follows, own, kinds, k = collections.Counter(), collections.Counter(), collections.Counter(), brown_lm.CLASSES
    for i in rows:
        follows.update(zip([of(b""), *map(of, tokens[i])], map(of, tokens[i])))
    for w, m in c.items():
        own[of(w)] += m
        kinds[of(w)] += 1
    before = collections.Counter()
    for (a, _), m in follows.items():
        before[a] += m
    share = [(own[x] + 1e-6) / (n + 1e-6 * k) for x in range(k)]
    for r in got:
        t, logs = tokens[r.doc_id], 0.0
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        for a, b in zip([of(b""), *map(of, t)], t):
            logs += math.log10((follows[a, of(b)] + brown_lm.KAPPA * share[of(b)]) / (before[a] + brown_lm.KAPPA) * (c[b] + 1) / (own[of(b)] + kinds[of(b)] + 1))
        assert r.score == pytest.approx(logs, rel=1e-9)


def test_brown_model_without_training_texts_and_on_held_out_ones(spark, docs, none):
    assert {(r.n_known, r.train_tokens) for r in brown_rows(docs, F.lit(False))[0]} == {(0, 0)}
    assert brown_rows(none, F.lit(True))[0] == []
    held = registry.queries()["op5_brown_lm"](spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.05  # each token is likelier by an eighth, on 200 texts


def test_neighbour_counts_are_summed_in_a_tree(spark, monkeypatch):
    rows = [(i if i < 3 else None, None if i < 3 else b"w%d" % i, part, [i, i + part % 3 + 1], [1, part]) for i in range(5) for part in range(23) if (i + part) % 4]
    each = spark.createDataFrame(rows, "i int, w binary, part int, codes array<smallint>, ns array<int>")

    def sums(df):
        return {(r.i, r.w): sum((collections.Counter(dict(zip(p.codes, p.ns, strict=True))) for p in r.p), collections.Counter()) for r in df.collect()}

    want = sums(brown_lm.gathered(each, 23))
    monkeypatch.setattr(brown_lm, "FAN", 3)
    tree = brown_lm.gathered(each, 23).collect()
    assert sums(brown_lm.gathered(each, 23)) == want and max(len(r.p) for r in tree) <= 3


def test_words_move_to_the_class_of_most_likelihood(monkeypatch):
    monkeypatch.setattr(brown_lm, "CLASSES", 3)
    rng = np.random.default_rng(9)
    g = rng.integers(0, 40, (3, 3)).astype(float) + 30
    present = rng.integers(0, 3, 6)
    owner, code, n = np.repeat(np.arange(6), 6), np.tile(np.arange(6), 6), rng.integers(0, 9, 36)
    xlogx = lambda x: x * math.log(x) if x > 1 else 0.0

    def gain(u, b):
        stay, total = b == present[u], 0.0
        for c in range(3):
            left, right = n[6 * u + c], n[6 * u + 3 + c]  # classes before and after the word
            for cell, k in ((g[c, b], left), (g[b, c], right)):
                total += xlogx(cell) - xlogx(cell - k) if stay else xlogx(cell + k) - xlogx(cell)
        for margin, k in ((g.sum(axis=1)[b], sum(n[6 * u + 3 : 6 * u + 6])), (g.sum(axis=0)[b], sum(n[6 * u : 6 * u + 3]))):
            total -= xlogx(margin) - xlogx(margin - k) if stay else xlogx(margin + k) - xlogx(margin)
        return total

    want = [max(range(3), key=lambda b: gain(u, b)) for u in range(6)]
    assert brown_lm.best_classes(present, owner, code, n, g).tolist() == want


def test_exchange_finds_word_classes():
    a, n = np.zeros((8, 8)), 100
    a[:4, 4:], a[4:, :4] = n, n  # two classes that follow each other
    cls = brown_lm.exchange(a, 2)
    assert len(set(cls[:4])) == len(set(cls[4:])) == 1 and cls[0] != cls[7]


def test_language_of_held_out_texts(spark, docs, none):
    got = registry.queries()["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    model = language_id.train(docs)
    out = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model, keep={"doc_id": F.col("doc_id")}).collect()}
    assert all(out[i] == "und" for i in (0, 1, 2, 3, 5)) and out[4] != "und"
    assert language_id.train(none) is None and {r.lang_pred for r in language_id.identify(docs, None, keep={"doc_id": F.col("doc_id")}).collect()} == {"und"}


def test_languages_of_copies_are_learned(spark):
    de = "der schnelle braune Fuchs springt über den faulen Hund und die Katze schläft"
    for ids in ("id", "0", "null"):
        copies = spark.range(3000).selectExpr(f"cast({ids} as bigint) as doc_id", f"'{de}' as text", "'de' as lang")
        rows = copies.unionByName(spark.range(3000).selectExpr("id + 5000 as doc_id", "concat('the quick brown fox number ', id, ' jumps over a lazy dog and the cat') as text", "'en' as lang"))
        model = language_id.train(rows.select("text", "lang"))
        langs, _ = language_id.predict(model, [de, "the quick brown dog and the lazy fox"])
        assert langs == ["de", "en"]


def test_toxicity_of_held_out_texts(spark, docs, none):
    got = registry.queries()["op7_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and got[got.toxic == 0].predicted.mean() < 0.05 and got[got.toxic == 1].predicted.mean() > 0.5
    labels = spark.createDataFrame([(10, 1), (13, 0), (8, None)], "doc_id bigint, toxic int")
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0)), toxicity.train(none, labels)):
        assert toxicity.score(docs, model, keep={"doc_id": F.col("doc_id")}).where("score between 0 and 1").count() == len(TEXTS) + 1


def test_license_base_places_and_suppression(spark, docs, none):
    got = {r.doc_id: r for r in license_scan.summarize(license_scan.matches(docs)).collect()}
    assert len(got) == len(TEXTS)
    phrases = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(raw(t))
        at = [(k, v) for p, v in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    text = "Licensed under the Apache License, Version 2.0 (the License); GNU General Public License v3 license. SPDX-License-Identifier: MIT"
    one = spark.createDataFrame([(1, text)], "doc_id int, text string")
    kept = {(r.label, r.priority) for r in license_scan.matches(one).where("kept").collect()}
    assert ("apache-2.0", license_scan.FULL) in kept and ("mit", license_scan.SPDX) in kept and ("apache", license_scan.BASE) not in kept
    assert license_scan.summarize(license_scan.matches(none)).count() == 0


def shortest(rx):
    """The text of fewest words that a rule's expression matches."""
    rx = rx.replace("[0-9]+", "7").replace(" ?", " ")
    while "(" in rx:
        rx = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] else min(m[1].split("|"), key=lambda x: x.count(" ")), rx)
    return rx.replace("@", "")


def test_license_rules_match_their_own_texts_only(spark):
    table = license_scan.rules()
    long = {r[0]: license_scan.longest(r[5]).replace("@", "") for r in table}
    short = {r[0]: shortest(r[5]) for r in table}
    assert len({r[5] for r in table if r[2] != license_scan.BASE}) == len([r for r in table if r[2] != license_scan.BASE])
    rows = [(k, f"filler words go here {t} and more of them follow") for sign, texts in ((1, long), (-1, short)) for i, t in texts.items() for k in [sign * (i + 1)]]
    other = {r[0]: re.sub(rf"\b{r[4]}\b", "zzz", long[r[0]]) for r in table if r[4] != r[3]}
    rows += [(10_000 + i, t) for i, t in other.items()]
    got = {(r.id, r.rule, r.start, r.stop) for r in license_scan.matches(spark.createDataFrame(rows, "doc_id int, text string")).where("rule is not null").collect()}
    for r in table:
        i = r[0]
        assert re.fullmatch(r[5].replace("@", ""), long[i]) and re.fullmatch(r[5].replace("@", ""), short[i])
        assert (i + 1, i, 4, 3 + len(long[i].split())) in got, long[i]
        assert (-i - 1, i, 4, 3 + len(short[i].split())) in got, short[i]
    assert not [(d, i) for d, i, _, _ in got if d >= 10_000 and d == 10_000 + i]


NOTICES = {
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\n you may not use this file except in compliance with the License.\n You may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0\n": "apache-2.0",
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions": "bsd",
    "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2.0-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later",
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "mit-or-apache-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file": "boost",
    "GNU General Public License, version 2, with the Classpath Exception: GPL v2 with Classpath Exception": "classpath-exception-2.0",
}


def test_license_labels_of_common_notices(spark):
    rows = list(enumerate(NOTICES)) + [(100, "Our kitchen licenses nobody; the exception is a warranty of joy in this domain, all rights and wrongs.")]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.summarize(license_scan.matches(spark.createDataFrame(rows, "doc_id int, text string"))).collect()}
    for i, label in enumerate(NOTICES.values()):
        assert label in got[i], (i, got[i])
    assert "gpl-2.0" not in got[8] and "mit" not in got[9] and got[100] == [""]


EXPRESSIONS = {
    "SPDX-License-Identifier: (MIT AND BSD-3-Clause)": ("mit-and-bsd-3-clause", ["mit", "bsd-3-clause"], 0, 8),
    "x\tSPDX-License-Identifier: GPL-2.0-or-later WITH Bison-exception-2.2 */": ("gpl-2.0-or-later-with-bison-exception-2.2", ["gpl-2.0-or-later-with-bison-exception-2.2"], 1, 14),
    "// SPDX-License-Identifier: BSD-2-Clause-Patent\nor MIT": ("bsd-2-clause-patent", ["bsd-2-clause-patent"], 0, 7),
    "SPDX-License-Identifier:GPL-2.0+": ("gpl-2.0-or-later", ["gpl-2.0-or-later"], 0, 6),
    "(SPDX-License-Identifier: MIT AND ( Apache-2.0 OR BSD-2-Clause )))": ("mit-and-(apache-2.0-or-bsd-2-clause)", ["mit", "apache-2.0", "bsd-2-clause"], 0, 12),
    "SPDX-License-Identifier: MIT AND (Zlib OR (ISC": ("mit-and-(zlib-or-(isc))", ["isc", "mit", "zlib"], 0, 8),
    "SPDX-License-Identifier: Apache-2.0 OR MIT\t OR  mit.": ("mit-or-apache-2.0", ["mit", "apache-2.0"], 0, 10),
    "SPDX-License-Identifier : LicenseRef-Own.1 and the rest": ("the-and-licenseref-own.1", ["the", "licenseref-own.1"], 0, 8),
}


def test_license_expressions(spark):
    none = ["SPDX-License-Identifier:", "SPDX-License-Identifier:\nMIT", "xSPDX-License-Identifier: MIT", "SPDX-License-Identifier: MITé", "SPDX-License-Identifier: (", "\ue0f1spdx-license-identifier: MIT", "\ue0f1spdx"]
    rows = list(enumerate([*EXPRESSIONS, *none])) + [(100, "a SPDX-License-Identifier: MIT, SPDX-License-Identifier: Zlib; " * 3000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = collections.defaultdict(list)
    for r in license_scan.matches(df).where("rule = -1").collect():
        got[r.id].append((r.label, r.operands, r.start, r.stop, r.kept))
    for i, want in enumerate(EXPRESSIONS.values()):
        assert got.pop(i) == [(*want, True)]
    many = got.pop(100)
    assert not got and sorted((x[2], x[0]) for x in many) == sorted([(9 * k + 1, "mit") for k in range(3000)] + [(9 * k + 5, "zlib") for k in range(3000)])
    labels = {r.doc_id: r.labels for r in license_scan.summarize(license_scan.matches(df)).collect()}
    assert labels[0] == "mit-and-bsd-3-clause" and labels[2] == "bsd-2-clause-patent" and labels[100] == "mit,zlib"


def test_license_rows_that_repeat(spark):
    rows = [(1, "the MIT License, mit license"), (None, None)] * 3 + [(1, "mit")]
    got = license_scan.summarize(license_scan.matches(spark.createDataFrame(rows, "doc_id int, text string").repartition(3))).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in got) == [(0, 0, 0, "")] * 3 + [(1, 1, 0, "")] + [(1, 5, 2, "mit")] * 3


def test_main_text_of_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    for r in registry.queries()["op6_wrapper_text"](spark, SF).collect():
        body = re.search("<article>(.*?)</article>", pages.html[r.page_id], re.S)[1]
        want = [x for y in re.split(r"</?(?:p|h1)>", body) if (x := " ".join(html.unescape(re.sub("<[^>]+>", " " if "<br" in y else "", y)).split()))]
        assert r.text.split("\n") == want and r.n_chars == len(r.text)
    page = "<html><body><div class='nav'>menu {0}</div><div id=content><h2>T {0}</h2><p>Body {0} &amp; more<br>text that is long enough to count</p><div class='comments'><p>reply</p></div><ul><li>i{0}<li>j</ul></div><div id=foot>same everywhere</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(5)] + [(9, None, None), (10, "u", ""), (11, "http://x.example/", "plain <b>text</b>")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id int, url string, html string"), keep={"page_id": F.col("page_id")}).collect()}
    assert got[3] == "T 3\nBody 3 & more text that is long enough to count\ni3\nj" and got[9] == got[10] == "" and got[11] == "plain text"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, kept = docs, [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(now.count())
        assert i == len(p.STAGES) - 1 or now.columns == docs.columns
    assert kept[1] <= kept[0] and kept[2] < kept[1] and kept[5] == kept[4]
    first = spark.read.parquet(str(tmp_path / "1"))
    groups = simhash.near_duplicates(first)
    assert groups.where("doc_id <> component_id").count() == 0
    assert p.STAGES[2][1](spark, docs.limit(0), SF).count() == 0 and p.STAGES[3][1](spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages_keep_the_rows_of_brute_force(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(24)]
    texts += [texts[0], texts[1], texts[2] + " w1", texts[3].upper(), None, "", "  "]
    ids = [5, 5, 5, None, None, None, 3, 3, 9, 9, *range(20, 34), 1, None, 4, 5, 40, None, 41]
    rows = [(d, t, "en", ["s", "t", None][i % 3], i) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[0], rows[4], rows[-2]]  # repeated in full
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")

    def keys(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(hashes, key=lambda k: (k[0] is None, k[0] or 0, hashes[k]))
    fps = {texts[r.doc_id]: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    part = components([fps[t] for _, t in order])
    want = sorted((order[i] for i in sorted(set(part))), key=repr)
    kept = p.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and keys(kept) == want
    kept = spark.createDataFrame(kept.collect(), docs.schema)

    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(raw(r.text))
        grams |= {tuple(w[i : i + min(13, len(w))]) for i in range(len(w) - min(13, len(w)) + 1) if w}
    long = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(WORD.findall(raw(r.text))) >= 13)
    dirty = docs.union(spark.createDataFrame([(5, texts[7] + " " + long, "en", "s", 1), (None, long, "en", "s", 1)], docs.schema))

    def clean(t):
        w, hit = WORD.findall(raw(t)), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                hit |= set(range(i, i + n)) if tuple(w[i : i + n]) in grams else set()
        return not hit or 20 * len(hit) < len(w)

    assert keys(p.drop_contaminated(spark, dirty, SF)) == sorted(((r.doc_id, r.text) for r in dirty.collect() if clean(r.text)), key=repr)

    # the mix takes a source's documents in the order of their keys' hashes, from the first again after the last
    at = kept.select("doc_id", "text", "source", F.xxhash64(p._row_key()).alias("h")).collect()
    size = {(r.doc_id, r.text): len(SPACED.findall(raw(r.text))) for r in at}
    goal = {r.source: round(r.target) for r in mixing.targets(kept.select("source", F.size(mixing.words_of(F.col("text"), mixing.SPACE_GAP)).alias("size"))).collect()}
    mixed = []
    for source, left in goal.items():
        own = sorted((r for r in at if r.source == source), key=lambda r: r.h)
        took = collections.Counter()
        for r in own * 2:
            n = min(left, size[r.doc_id, r.text])
            took[r.doc_id, r.text] += n
            left -= n
        for k, n in took.items():
            mixed += [k] * math.floor(n / size[k] + 0.5) if size[k] else []
    assert keys(p.mix_sources(spark, kept, SF)) == sorted(mixed, key=repr)


def test_pipeline_stages_keep_clashing_columns_and_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(i) for i, c in enumerate(["score", "predicted", "text_hash", "bad", "taken", "copies", "key", "row", "_copy", "c0", "size", "id", "fp", "component"])})
    for (name, stage), n in zip(p.STAGES[:-1], (100, 100, 100, 100), strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > n, name
        assert {tuple(r) for r in out.select("key", "predicted", "_copy", "component").distinct().collect()} == {(6, 1, 8, 13)}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert p.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("order", [1, 2])
def test_kneser_ney_equals_brute_force(spark, order):
    rng = np.random.default_rng(2)
    kinds = [[f"a{i}" for i in range(12)], [f"a{i}" for i in range(8)] + ["bad", "worse"]]
    texts = [(i, " ".join(rng.choice(kinds[i % 2], rng.integers(3, 12))), i % 2) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), most_toxic=10**6, most_ordinary=10**6, most_pairs=10**6, orders=(order,), stretches=(0,), bases=(5.0,))
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).alias("p")).collect()}
    words, pairs = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    two, three = set(), set()
    for i, t, y in texts:
        w = t.split()
        two |= {(y, part[i], *g) for g in zip(["", *w], w)}
        three |= {(y, part[i], *g) for g in zip(["", *w], w, w[1:])}
    for y, _, _, w in two:
        words[y][w] += 1
    for y, _, _, v, w in three:
        pairs[y][v, w] += 1

    def discount(counts):
        n1, n2 = (sum(c == k for c in counts) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    vocabulary, every = set(words[0]) | set(words[1]), sum(sum(c.values()) for c in words)

    def p1(y, w):
        d, n = discount(words[y].values()), sum(words[y].values())
        shared = (words[0][w] + words[1][w] + 5) / (every + 5 * (len(vocabulary) + 1))
        return max(words[y][w] - d, 0) / n + d * len(words[y]) / n * shared

    def p2(y, v, w):
        after = {x: c for (u, x), c in pairs[y].items() if u == v}
        d, n = discount(pairs[y].values()), sum(after.values())
        return max(after.get(w, 0) - d, 0) / n + d * len(after) / n * p1(y, w) if n else p1(y, w)

    for t in [texts[0][1], texts[1][1], "bad worse unseen a1", "unseen"]:
        w = t.split()
        want = sum(math.log((p1(1, b) / p1(0, b)) if order == 1 else p2(1, a, b) / p2(0, a, b)) for a, b in zip([None, *w], w)) / len(w)
        assert toxicity.evidence_of(t.upper().encode(), model) == pytest.approx(want, rel=1e-9)
        got = toxicity.score(spark.createDataFrame([(t,)], "text string"), model).first().score
        assert got == pytest.approx(1 / (1 + math.exp(-(model["slope"] * want + model["bias"]))))
    assert sum(p1(1, w) for w in vocabulary) + p1(1, "unseen") == pytest.approx(1)


def test_samples_hold_at_any_share(spark):
    from loomspark.llm.common import below

    h = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for share, lo, hi in ((0.0, 0, 0), (1e-4, 5, 45), (0.5, 99_000, 101_000), (1.0, 200_000, 200_000), (7.0, 200_000, 200_000)):
        assert lo <= h.where(below(F.col("h"), share)).count() <= hi
    assert spark.range(1).where(below(F.lit(-(2**63)), 1e-15)).count() == 1  # a bound so small still lets rows in


def test_files_with_other_preparation_use_their_own_tokenizer(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    assert token_store.goes_word_by_word(path)
    other = json.load(open(path, encoding="utf-8"))
    other["normalizer"] = {"type": "NFC"}  # upper case stays
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    assert not token_store.goes_word_by_word(str(tmp_path / "other.json"))
    texts, t = ["Upper lower", None, "x  y\nZ"], Tokenizer.from_file(str(tmp_path / "other.json"))
    got = token_store.write_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), str(tmp_path / "other.json")).collect()
    for r in got:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))

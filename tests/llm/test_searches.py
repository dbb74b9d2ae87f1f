"""Nearest vectors, prefix tries and fill-in-middle texts against brute force and SQL."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from compare import difference
from loomspark.llm import exact_topk, fill_middle, prefix_trie, registry

SF = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.mark.parametrize("sf", SF)
@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_prefix_trie", "op13_fill_in_middle"])
def test_query_equals_sql(spark, sf, name):
    assert difference(spark, sf, registry.queries()[name], registry.oracle_sql()[name]) is None


def nearest(rows, every, k, scale=256):
    """Sorted (query_id, rank, id, score) by brute force over rows (id, vector)."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q is None or q % every:
            continue
        found = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), i) for b, (i, w) in enumerate(ok) if a != b and len(v) == len(w)]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


VECTOR_ROWS = "vec_id bigint, embedding array<double>, rank int, row string, score double"


def found(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], VECTOR_ROWS).repartition(parts)
    got = exact_topk.search(df, "vec_id", "embedding", **more)
    assert got.columns == ["query_id", "rank", "id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_nearest_vectors_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.5, -0.25]), (None, None), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1e307, 0.0]), (50, []), (51, []), (100, [1.0, 2.0, 3.0]), (150, [9.9, -3.1]), (-50, [0.001, -0.001]), (7, [2.0, 2.0]), (8, [2.0, 2.0])]
    assert found(spark, rows, every=50, k=5) == nearest(rows, 50, 5)
    assert found(spark, rows[:1], every=50, k=5) == []
    assert found(spark, [], every=50, k=5) == []


@pytest.mark.parametrize("size", [1.0, 1e9, 1e17])  # floats, doubles, and numbers beyond 64 bits
def test_nearest_vectors_in_rounds_tiles_and_trees(spark, monkeypatch, size):
    rng = np.random.default_rng(5)
    for name, value in {"TILE_QUERIES": 7, "TILE_ROWS": 16}.items():
        monkeypatch.setattr(exact_topk, name, value)
    same = [float(x) for x in rng.normal(size=6) * size]
    rows = [(int(i), same if i % 3 == 0 else [float(x) for x in rng.normal(size=6) * size]) for i in rng.permutation(300)]
    assert found(spark, rows, parts=40, every=10, k=5, round_mb=0.001) == nearest(rows, 10, 5)


def test_tiles_break_ties_by_the_smaller_id():
    q = {"row": np.array([100, 101]), "v": np.ones((2, 3))}
    top = exact_topk.TopLists(q, 4)
    for ids in ([9, 8, 7, 6, 5, 4], [3, 12, 1], [2]):
        top.add(np.array(ids) + 90, np.array(ids), np.zeros(len(ids), bool), np.ones((len(ids), 3)))
    assert top.id.tolist() == [[1, 2, 3, 4]] * 2
    top = exact_topk.TopLists(q, 4)
    top.add(np.array([100, 7, 101]), np.array([1, 2, 3]), np.array([False, False, True]), np.ones((3, 3)))
    assert top.id[0, :2].tolist() == [2, 3] and top.score[0, 2] == exact_topk.NONE and top.id[1, :2].tolist() == [1, 2]


def trie_of(rows):
    """{(conv_id, depth): rest of the row} by walking every prefix; rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    path = {c: own.get(c - int(math.fmod(c, 5)), [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    members = defaultdict(set)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
    out = {}
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in m if len(path[c]) == len(node))))
        leaves = sum(all(x[: len(n)] != n or len(x) == len(n) for x in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        out[min(m), len(node)] = (parent, len(m), sum(len(n) == len(node) + 1 for n in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def rows_of_trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "h", "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, h1 string, _piece string")
    got = prefix_trie.trie(df, **more).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def test_trie_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), ["user", "bot"][t % 2], ["hi", "é", "", "bye"][int(x)]) for c in rng.permutation(60) for t, x in enumerate(rng.integers(0, 4, rng.integers(1, 12)))]
    rows += [(100, None, None, None), (100, 1, "user", "hi"), (100, 1, "user", "hi"), (100, 1, "bot", "hi"), (None, 1, "user", "lost"), (-7, 0, "user", "hi"), (-3, 0, "user", "hi"), (203, 0, "user", "alone"), (7 * 10**9, 2, "user", "late")]
    rows += [(500, t, "user", f"turn {t}") for t in range(300)] + [(502, t, "user", f"turn {t}") for t in range(300)]
    rows += rows[:5]
    want = trie_of(rows)
    assert rows_of_trie(spark, rows) == want
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    assert rows_of_trie(spark, rows, most=40) == want  # the longest conversations in pieces, ends in short runs


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", "same") for c in range(400) for t in range(3)]
    assert rows_of_trie(spark, rows) == trie_of(rows)
    assert rows_of_trie(spark, []) == {}
    assert rows_of_trie(spark, [(None, 1, "user", "x")]) == {}


TEXTS = [None, "", "a", "a<P>b", "x<S>", "<M>", "<P", "a<", "<S<", "<<<<<", ">P>S>M>", "\r\n", "é́👩‍🚀", "\x00\x01", "plain words of some length " * 9, "long " * 40_000]


def test_fill_in_middle_equals_brute_force(spark):
    rows = [(i, t, 1, "f", 2) for i, t in enumerate(TEXTS * 12)] + [(None, "no id", 1, "f", 2), (3, "again", 1, "f", 2), (3, "again", 1, "f", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, form string, output int")
    got = sorted(map(tuple, fill_middle.fill_in_middle(df).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        t, h = t or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[j : j + 8], 16) for j in (0, 8, 16, 24))
        n = len(t)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        plain = form == "plain"
        want.append((i, n, form, None if plain else a, None if plain else b - a, *(hashlib.sha256(x.encode()).hexdigest() for x in (out, t)), out))
    assert got == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_of_words_is_restored():
    import regex

    words = regex.compile(r"\S+\s*")
    for i, t in enumerate(["one two  three", "  lead", "tail  ", "   ", "a b c d e f g h"] * 20):
        n, form, a, b, out = fill_middle.rearrange(t, str(i), words, salt="other", moved=100)
        assert fill_middle.restore(out, form) == t
        assert form != "plain" and n == len(words.findall(t)) + (t.strip() == "") 
        ends = [0, *fill_middle.unit_ends(t, words)]
        assert a in ends and a + b in ends

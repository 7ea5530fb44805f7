"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from martlens.llm import periodic, spelling, topk_search


# ---- 11: periodic runs

def brute_runs(w, periods, least):
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, periods * q):
                out.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        n, k = rnd.randrange(50), rnd.choice([1, 2, 3, 6])
        w = [str(rnd.randrange(k)).encode() for _ in range(n)]
        if n and rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randrange(1, 8)
            w = [w[min(a + (i - a) % p, n - 1)] if i >= a else w[i] for i in range(n)]
        assert sorted(map(tuple, periodic.find_runs(w).tolist())) == brute_runs(w, 4, 6)
        assert sorted(map(tuple, periodic.runs_of_symbols([int(x) + 1 for x in w]).tolist())) == brute_runs(w, 2, 2)


def test_extensions_equal_brute_force():
    rnd = random.Random(6)
    s = [rnd.randrange(1, 4) for _ in range(300)] + [1, 2] * 60
    t = periodic.SuffixTree(s)
    i, j = np.array([(a, b) for a in range(0, len(s), 7) for b in range(len(s)) if a != b]).T

    def common(a, b):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        return n

    assert t.lce(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_long_periodic_text():
    w = [b"a", b"b", b"c"] * 20_000 + [b"x"] + [b"a"] * 30_000
    assert periodic.find_runs(w).tolist() == [[0, 60_000, 3], [60_001, 30_000, 1]]


def test_collapse_on_edges(spark, edges):
    rows = periodic.collapse_runs(edges).collect()
    assert len(rows) == edges.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == by[3]["n_words"] == by[5]["n_words"] == 0 and by[2]["collapsed"] == "" and by[2]["runs"] == []
    assert by[7]["collapsed"] == "a b c d e f g h i j" and [tuple(x) for x in by[7]["runs"]] == [(0, 40_000, 10)]
    assert by[None]["n_words"] == 5
    assert periodic.run_report(edges.where("false")).count() == 0
    none = {r["doc_id"]: r for r in periodic.run_report(edges).collect()}[2]
    assert none["start"] is None and none["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


# ---- 12: spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


@pytest.mark.parametrize("part", [20_000, 3])
def test_variants_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART", part)  # 3: common bigrams are split into parts
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 8))) for _ in range(250)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ababab"}
    counts = {w: rnd.choice([3, 4, 7, 15, 40]) for w in words}
    text = [" ".join([w] * n) for w, n in counts.items()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(text)], "doc_id long, text string, word int")
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == variants(counts)


def test_pivots_are_disjoint_and_cheapest():
    rnd = random.Random(8)
    for _ in range(300):
        at = rnd.sample(range(9), 3)
        cost = [rnd.randrange(20) for _ in range(3)]
        got = spelling.choose_pivots(list(zip(at, range(3))), cost.__getitem__)
        assert abs(got[0][0] - got[1][0]) >= 2
        best = min(cost[i] + cost[j] for i, j in itertools.combinations(range(3), 2) if abs(at[i] - at[j]) >= 2)
        assert sum(cost[g] for _, g in got) == best


def test_words_of_edges(spark, edges):
    got = {r["word"]: r["n"] for r in spelling.word_counts(edges).collect()}
    assert got == {"alpha": 3, "gamma": 3, "delta": 3, "epsilon": 3, "theta": 3}
    assert spelling.spelling_variants(edges.where("false")).count() == 0
    assert {r["word"] for r in spelling.spelling_variants(edges).collect()} == set(got)
    long = spark.createDataFrame([(1, "Q" * 300_000 + " ") for _ in range(3)], "doc_id long, text string")
    assert [(len(r["word"]), r["n"]) for r in spelling.spelling_variants(long).collect()] == [(300_000, 3)]


def test_letter_lost_by_checksum():
    import zlib

    hit = next(f"w{i}" for i in range(10_000) if zlib.crc32(f"5:w{i}".encode()) % 97 == 0)
    assert len(spelling.misspelt(5, hit)) == len(hit) - 1 and spelling.misspelt(6, "stays") in ("stays", spelling.misspelt(6, "stays"))


# ---- 13: exact top-k

def brute_top(rows, k=5):
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(live):
        if i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(live) if a != b)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(8192, 512), (40, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk_search, "SHARD", shard)
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "PER_CELL", 16)
    monkeypatch.setattr(topk_search, "SHARED_BLOCKS", 2)
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 6) for i in range(200)]  # a third of all rows are one vector
    rows += [(50, rows[50][1]), (50, [0.5] * 6), (450, None), (500, [0.1, None] * 3), (550, [float("nan")] * 6), (600, [float("inf")] * 6),
             (None, [1.0] * 6), (650, [0.5, 0.5]), (700, []), (51, [9.0, 9.0]), (750, [1e12] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk_search.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute_top(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 3 * 65536)]
    assert topk_search.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk_search.top_k(df, df.where("false")).count() == 0
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.top_k(huge, huge.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63))]

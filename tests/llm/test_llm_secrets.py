"""The Markov spans of operator 7 against brute force, long runs, and what base spans leave of a run."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from martlens.llm import secret_scan as S

B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def spans_of(spark, texts, ratio, margin=0.25, floor=16.0):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    r = F.array(*[F.lit(float(x)) for x in ratio])
    t = F.coalesce(F.col("text"), F.lit(""))
    got = df.select("i", F.lit(0).alias("z")).join(
        df.select("i", S.bound(r, lambda q: S.found_spans(t, q, margin, floor)).alias("s")), "i").select("i", "s.spans").collect()
    return {r["i"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in got}


@pytest.fixture(scope="module")
def seen(spark, docs):
    """The small table with some secrets to learn from."""
    rnd = random.Random(2)
    kinds = [("password=", B62, 20), ("", "0123456789abcdef", 40), ("AKIA", B62[:26] + B62[52:], 16)]
    some = [(50_000 + i, k + "".join(rnd.choices(a, k=n))) for i in range(120) for k, a, n in [kinds[i % 3]]]
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(some, "doc_id long, text string"))


@pytest.fixture(scope="module")
def ratio(seen, labels):
    return S.train(S.labelled_samples(seen, labels)).first()["ratio"]


def brute(text, ratio, margin=0.25, floor=16.0):
    from tests.llm.test_llm_operators import base_spans

    base = [(a, b, k) for a, _, b, k in base_spans(text)]
    masked = list(text)
    for a, b, _ in base:
        masked[a:b] = "\x00" * (b - a)
    out = [(k, a, b) for a, b, k in base]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", "".join(masked)):
        w = m.group()
        total = sum(ratio[128 * ord(x) + ord(y)] for x, y in zip(w, w[1:]))
        if total > max(floor, margin * (len(w) - 1)):
            out.append(("markov", *m.span()))
    return sorted(out, key=lambda x: (x[1], S.KINDS.index(x[0]), x[2]))


def test_added_spans_equal_brute_force(spark, docs, ratio):
    rnd = random.Random(3)
    texts = [r["text"] or "" for r in docs.select("text").collect()]

    def piece():
        return rnd.choice([
            "".join(rnd.choices(B62, k=rnd.randrange(4, 40))), "deadbeef" * rnd.randrange(1, 5), "AKIA" + "".join(rnd.choices(B62[:36], k=rnd.randrange(10, 25))),
            "token=" + "".join(rnd.choices(B62, k=rnd.randrange(3, 12))), "ordinary_name", "0123456789" * rnd.randrange(1, 4), "é", " ", "-", "\n"])

    texts += ["".join(rnd.choice([piece(), " "]) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    got = spans_of(spark, texts, ratio)
    assert all(got[i] == brute(t, ratio) for i, t in enumerate(texts))
    assert sum(any(k == "markov" for k, _, _ in s) for s in got.values()) > 50


def test_short_runs_single_alphabets_and_rests_are_judged(spark, ratio):
    """Keys of 12 and more characters of any alphabet, and the part of a run beside a base span."""
    texts = ["q7Zp2LxR8vTw", "qZpLxRvTwKmBnHcYsDfG", "q7Zp2LxR8vTw9KmB3nHc-" + "deadbeef" * 3, "international development organisation"]
    got = spans_of(spark, texts, ratio)
    assert got[0] == [("markov", 0, 12)] and got[1] == [("markov", 0, 20)]
    # what stands beside the hex run: 21 characters before it, less those that the hex run takes
    assert [k for k, _, _ in got[2]] == ["markov", "hex"] and got[2][0][1:] == (0, 21)
    assert got[3] == []


def test_long_runs_and_many_spans_are_linear(spark, labels, seen):
    rnd = random.Random(4)
    run = "".join(rnd.choices(B62, k=1_000_000))
    many = "token=abcdef1 x " * 20_000
    df = seen.unionByName(spark.createDataFrame([(-1, run), (-2, many), (-3, "a" * 1_000_000)], "doc_id long, text string"))
    at = time.time()
    got = {r["doc_id"]: r for r in S.secret_report(df, labels).where("doc_id < 0").collect()}
    assert got[-1]["spans"] == "markov:0:1000000" and got[-2]["n_assign"] == 20_000 and got[-2]["spans"].endswith("assign:319984:319997")
    assert time.time() - at < 120


def test_redact_keeps_other_columns(spark, labels, docs):
    df = docs.select("doc_id", "text", F.lit(7).alias("_base"), F.lit("u").alias("text_"), F.lit(1).alias("r"))
    got = S.redact(df, labels)
    assert got.columns == df.columns
    assert got.where("_base <> 7 or text_ <> 'u' or r <> 1").count() == 0
    one = spark.createDataFrame([(1, None), (2, "x password=abcdefgh token=ab1234567 y")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in S.redact(one, labels).collect()} == {1: None, 2: "x [SECRET] [SECRET] y"}

"""Long texts, rows without ids, hot groups and clashing columns in the training-data operators."""

import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from martlens.llm import langid, near_dup, packing, quality, substring
from tests.llm.conftest import SMALL
from tests.llm.test_llm_operators import rows

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_long_blank_runs_are_tokenised(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 30_000 + "b", "<|endoftext|>" + "\t" * 20_000 + "x", (" " * 9_999 + "y") * 5]
    texts += ["".join(rnd.choice([" " * rnd.randrange(9_000, 12_000), "\n\n", "word", "<|endoftext|>", "é "]) for _ in range(6)) for _ in range(20)]
    for t in texts:
        assert packing.token_ids(t, RANKS, PATTERN) == tok.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in packing.pack(df, RANKS, PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert n == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts[:2])}


def test_markup_is_cut_as_by_pattern_and_in_linear_time():
    rnd = random.Random(2)
    parts = ["<", ">", "<script", "</script>", "</SCRIPT >", "<style>", "</style>", "<!--", "-->", "x", " ", "&amp;", "&", ";", "<html lang='EN'>", "lang=fr"]

    def slow(t):
        t = re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", b" ", t)
        return re.sub(rb"<[^>]*>|&[#\w]{1,10};", b" ", t)

    def tag(t):
        m = re.search(rb"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", t)
        return m.group(1).decode().lower() if m else ""

    for _ in range(4000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(14))).encode()
        assert langid.plain_text(t) == slow(t) and langid.declared_language(t) == tag(t), t
    at = time.time()
    for t in (b"<", b"<!--", b"<script ", b"<style>", b"<html ", b"<html lang ", b"&", b"</script ", b"<script></script"):
        langid.plain_text(t * 100_000), langid.declared_language(t * 100_000)
    assert time.time() - at < 20


def test_posterior_equals_brute_force(spark):
    """Every page's verdict and confidence from the definition, on a small table."""
    rnd = random.Random(3)
    vocab = {"en": ["the", "cat", "sat", "there"], "fr": ["le", "chat", "était", "là"], "de": ["die", "katze", "saß", "dort"]}
    docs = [(lang, " ".join(rnd.choices(v, k=30))) for lang, v in vocab.items() for _ in range(5)]
    pages = []
    for i in range(60):
        lang = rnd.choice(list(vocab))
        body = " ".join(rnd.choices(vocab[lang], k=rnd.choice([0, 1, 3, 10])))
        pages.append((i, f"http://h{rnd.randrange(4)}.d{rnd.randrange(2)}.{rnd.choice(['fr', 'de', 'com'])}/x",
                      f"<html{rnd.choice(['', ' lang=' + lang])}><p>{body}</p>"))
    got = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"),
                                                    spark.createDataFrame(docs, "lang string, text string")).collect()}
    langs = sorted(vocab)
    table = np.full((3, langid.FEATURES), 0.5)
    for lang, t in docs:
        c = np.zeros(langid.FEATURES, np.int64)
        langid.trigram_counts(t.encode(), c)
        table[langs.index(lang)] += c
    logp = np.log(table / table.sum(axis=1, keepdims=True))
    seen = []
    for i, url, html in pages:
        c = np.zeros(langid.FEATURES, np.int64)
        n = langid.trigram_counts(b" ".join(re.sub(rb"<[^>]*>", b" ", html.encode()).split()), c)
        ll = logp @ c * (min(n, 100) / max(n, 1))
        host = url.split("/")[2]
        m = re.search("lang=([a-z]+)", html)
        seen.append((i, host, host.split(".", 1)[1], host.rsplit(".")[-1], m.group(1) if m else "", ll, int(ll.argmax()) if n else None))

    def counts(k, v):
        return np.array([sum(1 for s in seen if s[k] == v and s[6] == x) for x in range(3)], float)

    alls = np.array([sum(1 for s in seen if s[6] == x) for x in range(3)], float)
    whole = (alls + 1) / (alls.sum() + 3)
    for i, host, domain, suffix, declared, ll, best in seen:
        d = counts(2, domain)
        d = (d + 5 * whole) / (d.sum() + 5)
        h = counts(1, host)
        if best is not None:
            h[best] -= 1
        post = ll + np.log((h + 5 * d) / (h.sum() + 5))
        for k, v in ((4, declared), (3, suffix)):
            if v:
                post = post + np.log((counts(k, v) + 0.5) / (alls + 0.5 * len({s[k] for s in seen})))
        p = np.exp(post - post.max())
        assert got[i]["lang"] == langs[int(post.argmax())] and got[i]["confidence"] == pytest.approx(1 / p.sum(), rel=1e-9)
        assert got[i]["text_lang"] == (None if best is None else langs[best])


def test_languages_in_blocks_give_the_same(spark, monkeypatch):
    pages, docs = spark.read.parquet(f"{SMALL}/pages.parquet"), spark.read.parquet(f"{SMALL}/documents.parquet")

    def run():
        return {r["page_id"]: (r["lang"], r["text_lang"], round(r["confidence"], 9)) for r in langid.identify(pages, docs).collect()}

    want = run()
    monkeypatch.setattr(langid, "SENT", 1)
    assert run() == want


def test_near_copies_without_ids(spark):
    w = [f"w{i}" for i in range(60)]
    texts = [(5, w), (None, w[:-1] + ["x"]), (None, ["y"] + w[1:]), (None, ["alone"] * 3)]
    df = spark.createDataFrame([(i, " ".join(t), "k") for i, t in texts], "doc_id long, text string, row_key string")
    got = near_dup.near_duplicates(df).orderBy("n_shingles").collect()
    assert [r["component_id"] for r in got if r["n_shingles"] > 1] == [5, 5, 5] and sorted(r["kept"] for r in got) == [False, False, True, True]
    assert sorted(rows(near_dup.one_of_each(df), "doc_id"), key=str) == [(5,), (None,)]
    none = df.where("doc_id is null")
    assert near_dup.one_of_each(none).count() == 2  # the two copies become one


def test_template_below_the_limit_is_paired_in_blocks(spark, monkeypatch):
    """Texts that share a passage but are no near copies: one large bucket, no links, the planted pair found."""
    monkeypatch.setattr(near_dup, "PAIR_BLOCK", 50)
    rnd = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    texts = [shared + [f"{k}-{rnd.random()}" for _ in range(30)] for k in range(400)]
    texts.append(texts[7][:-1] + ["other"])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: (7 if i == 400 else i) for i in range(401)}


def test_cutoffs_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        good = rng.integers(0, 40, len(quality.CUTOFFS) + 1) * (rng.random(len(quality.CUTOFFS) + 1) < 0.2)
        bad = rng.integers(0, 10, len(quality.CUTOFFS) + 1)
        good[-1] = rng.integers(0, 800)
        got = quality.choose_cutoff(good, bad, 0.05, 0.001)
        best = (0.0, None)
        n = int(good.sum())
        for i, c in enumerate(quality.CUTOFFS):
            lost = int(good[:i + 1].sum())
            tail = sum(math.comb(n, k) * 0.05**k * 0.95 ** (n - k) for k in range(lost + 1)) if n else 1.0
            if not n or lost >= 0.05 * n or tail > 0.001:
                break
            gain = bad[:i + 1].sum() / max(bad.sum(), 1) - quality.GOOD_WEIGHT * lost / n
            best = (gain, c) if gain > best[0] + 1e-12 else best
        assert got[1] == best[1] and got[0] == pytest.approx(best[0])


def test_rules_act_in_every_language():
    """At sf0.1 every language has enough labels for a rule, and each rejects bad texts."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_rules(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    for r in got.where("not base_failed").groupBy("lang").agg(
            F.avg(F.when(F.col("quality") == 1, (~F.col("kept")).cast("int"))).alias("lost"),
            F.sum(F.when(F.col("quality") == 0, (~F.col("kept")).cast("int"))).alias("caught")).collect():
        assert r["lost"] <= 0.05 and r["caught"] > 0, r


def test_stages_carry_columns_of_any_name(spark, docs):
    import corpus_pipeline as C

    names = ["at", "runs", "_text", "_score", "_base", "rest", "row_key", "text_", "ratio", "key", "_parts"]
    src = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, src, SMALL)
        assert out.columns == src.columns, name
        wrong = [F.col(f"`{c}`") != F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names]
        assert out.where(F.array_max(F.array(*wrong))).count() == 0, name
    assert C.STAGES[-1][1](spark, src, SMALL).count() > 0


def test_substring_edges_with_clashing_columns(spark, edges):
    out = substring.remove_repeats(edges)
    assert out.columns == edges.columns and out.count() == edges.count()

import math

from martlens.functions.text import (
    BOOSTERS_DOWN, BOOSTERS_UP, NEGATORS, sentiment_class,
)
from martlens.operators.text import filter_stopwords, lexicon_sentiment

LEX = {"good": 1.9, "bad": -2.5, "love": 3.2, "very": 0.3, "no": -1.2}


def _py_score(text, lex=LEX):
    """The rules as stated in lexicon_sentiment, written as a plain loop."""
    boost = {w: 0.293 for w in BOOSTERS_UP} | {w: -0.293 for w in BOOSTERS_DOWN}
    toks = [w for w in text.split(" ") if len(w) > 1]
    if not toks:
        return 0.0
    vals = []
    for i, w in enumerate(toks):
        if w not in lex or w in boost:
            vals.append(0.0)
            continue
        v = lex[w]
        for d, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= d and toks[i - d] not in lex:
                s = boost.get(toks[i - d], 0.0) * damp
                v = v + (-s if v < 0 else s)
                if toks[i - d] in NEGATORS:
                    v = v * -0.74
        vals.append(v)
    if "but" in toks:
        b = toks.index("but")
        vals = [v * 0.5 if i < b else v * 1.5 if i > b else v for i, v in enumerate(vals)]
    x = sum(vals)
    c = max(-1.0, min(1.0, x / math.sqrt(x * x + 15)))
    return round(c, 4)


def test_sentiment_rules_match_plain_python(spark):
    texts = ["this is very good", "not good at all", "good but bad", "it was really not very good",
             "absolutely love it but the box was slightly bad", "bad", "", "a b c", "no good", "very very very good",
             "i never said it was bad", "hardly good and barely bad"]
    lex = spark.createDataFrame(list(LEX.items()), "term string, valence double")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, clean_comment string")
    got = {r["id"]: r["sentiment_score"] for r in lexicon_sentiment(df, lex).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - _py_score(t)) < 1e-9, (t, got[i], _py_score(t))


def test_stopwords_and_classes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("the product was not what i ordered it arrived late",)], "clean_comment string")
    assert filter_stopwords(df).first()["filtered_text"] == "ordered late"
    sc = spark.createDataFrame([(0.05,), (-0.05,), (0.0,)], "s double").select(sentiment_class(F.col("s"))).collect()
    assert [r[0] for r in sc] == ["Positive", "Negative", "Neutral"]


def test_joined_word_table_equals_broadcast_one(spark, monkeypatch):
    """The same scores whether the word table is broadcast or joined, with tokens split into parts, empty and null texts."""
    import random

    from martlens.operators import text as T

    rnd = random.Random(3)
    vocab = ["good", "bad", "very", "not", "but", "fine", "awful", "unknown", "slightly", "a", "so"]
    texts = ["", None, "but", "not very good but so bad"] + [" ".join(rnd.choices(vocab, k=rnd.randrange(1, 25))) for _ in range(300)]
    texts += ["good not good"] * 200 + [" ".join(["very good"] * 5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, clean_comment string")
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("fine", 0.8), ("awful", -2.0), ("but", 0.3)], "term string, valence double")
    want = {r["i"]: r["sentiment_score"] for r in T.lexicon_sentiment(df, lex).collect()}
    for parts in (1000, 1):
        monkeypatch.setattr(T, "TOKEN_PARTS", parts)
        got = T.lexicon_sentiment(df, lex, max_broadcast=0)
        assert got.columns == df.columns + ["sentiment_score"]
        assert {r["i"]: r["sentiment_score"] for r in got.collect()} == want

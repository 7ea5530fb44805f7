"""Rows and results of the steps that grew too large in round 4."""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from martlens.operators import churn, text

LEX = [("good", 1.9), ("bad", -2.5), ("fine", 0.8), ("awful", -2.0), ("but", 0.3), ("été", 1.1), ("odd", float("nan"))]


def _texts(spark):
    rnd = random.Random(5)
    vocab = ["good", "bad", "very", "not", "but", "fine", "awful", "unknown", "slightly", "a", "so", "été", "é"]
    texts = [None, "", "but", "not  very good", "odd one", "slightly odd but good"] + [" ".join(rnd.choices(vocab, k=rnd.randrange(1, 40))) for _ in range(400)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, clean_comment string").repartition(3, "i")


def _scores(df):
    return {r["i"]: repr(r["sentiment_score"]) for r in df.collect()}


def test_only_the_distinct_words_of_a_block_are_joined(spark, monkeypatch):
    met, real = [], text.token_facts
    monkeypatch.setattr(text, "token_facts", lambda tokens, words_t: met.append(tokens.count()) or real(tokens, words_t))
    lex = spark.createDataFrame(LEX, "term string, valence double")
    df = _texts(spark)
    got = text.lexicon_sentiment(df, lex, max_broadcast=0)
    assert _scores(got) == _scores(text.lexicon_sentiment(df, lex))
    # 8,000 tokens in three blocks of at most 14 words
    assert len(met) == 1 and met[0] <= 3 * 14


def test_small_blocks_and_slices_score_the_same(spark, monkeypatch):
    lex = spark.createDataFrame(LEX, "term string, valence double")
    df = _texts(spark)
    want = _scores(text.lexicon_sentiment(df, lex))
    monkeypatch.setattr(text, "BLOCK_BYTES", 300)
    monkeypatch.setattr(text, "SLICE_BYTES", 100)
    blocks = text.text_blocks(df)
    assert blocks.select("_block").distinct().count() > 20 and blocks.drop("_block").exceptAll(df).count() == 0
    for frame in (df, blocks):
        got = text.lexicon_sentiment(frame, lex, max_broadcast=0)
        assert got.columns == df.columns + ["sentiment_score"] and _scores(got) == want
    assert text.lexicon_sentiment(blocks, lex).columns == df.columns + ["sentiment_score"]


def test_texts_without_a_known_word(spark):
    lex = spark.createDataFrame([("good", 1.0)], "term string, valence double")
    df = spark.createDataFrame([(1, "other words"), (2, None), (3, "")], "i int, clean_comment string")
    assert set(_scores(text.lexicon_sentiment(df, lex, max_broadcast=0)).values()) == {"0.0"}
    assert text.lexicon_sentiment(df.where(F.col("i") > 9), lex, max_broadcast=0).count() == 0


def _train(spark):
    # the label is a step of x, so that trees differ little
    rows = spark.range(600).select(F.col("id").alias("customer_unique_id"), (F.hash("id") % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    return churn.stable_layout(churn.class_weights(rows.withColumn("churn", (F.col("x") > 10).cast("int"))))


def _fitted(train, n):
    return churn._models(n, ["x", "y"])["Random Forest"].fit(train)


def test_large_forest_grows_in_parts_that_hold_all_trees(spark, monkeypatch):
    grown, real = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: grown.append((self.getNumTrees(), self.getSeed())) or real(self, d))
    train = _train(spark)
    model = _fitted(train, churn.WHOLE_FOREST_ROWS + 1)
    assert sum(n for n, _ in grown) == 200 and max(n for n, _ in grown) == churn.TREES_AT_A_TIME and len(set(grown)) == len(grown)
    forest = model.stages[-1]
    assert forest.getNumTrees == 200 and len(forest.trees) == 200 and forest.numFeatures == 2 and forest.numClasses == 2
    assert abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9
    got = churn.score(model, train)
    assert got.where((F.col("score") < 0) | (F.col("score") > 1) | (F.col("prediction") != F.col("churn"))).count() == 0
    assert got.where((F.col("prediction") == 1) != (F.col("score") > 0.5)).count() == 0


def test_small_forest_is_that_of_one_plain_fit(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    train = _train(spark)
    plain = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), RandomForestClassifier(
        labelCol="churn", numTrees=200, maxDepth=10, featureSubsetStrategy="sqrt", weightCol="w", seed=42, maxMemoryInMB=512)]).fit(train)
    assert _fitted(train, 600).stages[-1].toDebugString.split("\n")[1:] == plain.stages[-1].toDebugString.split("\n")[1:]

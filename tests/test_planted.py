"""Models held against planted data with known coefficients."""

import math

import pytest
from pyspark.sql import functions as F

FEATS = ["x1", "x2", "x3"]
#: log-odds of the planted label per unit of each feature, and the intercept
TRUE = [1.5, -1.0, 0.0]
BIAS = 0.5


def unit(name):
    """A reproducible number in [0, 1) from the row's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(name), F.col("customer_unique_id"))), 1, 8), 16, 10).cast("double") / 2.0 ** 32


@pytest.fixture(scope="module")
def planted(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("customer_unique_id"))
    for f in FEATS:
        rows = rows.withColumn(f, (unit(f) - 0.5) * 4)
    odds = sum((F.col(f) * b for f, b in zip(FEATS, TRUE)), F.lit(BIAS))
    return rows.withColumn("churn", (unit("label") < 1 / (1 + F.exp(-odds))).cast("int")).withColumn(
        "part", F.when(unit("part") < 0.2, "test").otherwise("train"))


@pytest.fixture(scope="module")
def fitted(planted):
    """The linear model and the forest; boosting, a hundred fits one after another, is left to the quality tests."""
    from martlens.operators.churn import _models, class_weights, stable_layout

    train = stable_layout(class_weights(planted.where("part = 'train'")))
    models = _models(train.count(), FEATS)
    return {name: models[name].fit(train) for name in ("Logistic Regression", "Random Forest")}


def test_logistic_regression_finds_the_coefficients(fitted):
    lr = fitted["Logistic Regression"]
    scaled = lr.stages[-1].coefficients.toArray()
    sd, mean = lr.stages[1].std.toArray(), lr.stages[1].mean.toArray()
    slopes = scaled / sd
    assert all(abs(a - b) < 0.2 for a, b in zip(slopes, TRUE))
    assert abs(lr.stages[-1].intercept - (slopes * mean).sum() - BIAS) < 0.2


def test_models_order_and_score_like_the_planted_odds(planted, fitted):
    from martlens.operators.churn import auc, score

    test = planted.where("part = 'test'")
    odds = sum((F.col(f) * b for f, b in zip(FEATS, TRUE)), F.lit(BIAS))
    best = auc(test.select(F.col("churn").alias("label"), odds.alias("score"))).first()[0]
    for name, model in fitted.items():
        got = score(model, test)
        a = auc(got.select(F.col("churn").alias("label"), "score")).first()[0]
        assert best - 0.06 < a < best + 0.02, name
        # the prediction is the side of one half on which the probability lies
        assert got.where((F.col("prediction") == 1) != (F.col("score") > 0.5)).count() == 0


def test_forest_importance_orders_the_features(spark, fitted):
    from martlens.operators.churn import feature_importance

    imp = {r["feature"]: r["importance"] for r in feature_importance(fitted["Random Forest"], FEATS, spark).collect()}
    assert imp["x1"] > imp["x2"] > imp["x3"] and math.isclose(sum(imp.values()), 1.0, abs_tol=1e-9)

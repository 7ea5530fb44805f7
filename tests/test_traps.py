import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from martlens.functions.columns import whole_days
from martlens.functions.text import clean_text
from martlens.operators.rfm import first_rank_score, quantile_score


def test_whole_days_floor(spark):
    # Two hours backwards is -1 day; two hours forward over midnight is 0 days
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 1), dt.datetime(2020, 1, 1, 23)),
                                (dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 2, 1)),
                                (dt.datetime(2020, 1, 1, 0), dt.datetime(2020, 1, 3, 0))], "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(whole_days("a", "b")).collect()]
    assert got == [-1, 0, 2]


def test_qcut_scores_match_pandas(spark):
    rng = np.random.default_rng(5)
    vals = rng.gamma(2.0, 50.0, 300).round(2)
    pdf = pd.DataFrame({"id": range(300), "m": vals})
    got = quantile_score(spark.createDataFrame(pdf), "m", "s").toPandas().sort_values("id")["s"].to_numpy()
    exp = pd.qcut(pdf["m"], 5, labels=[1, 2, 3, 4, 5]).astype(int).to_numpy()
    assert (got == exp).all()
    rev = quantile_score(spark.createDataFrame(pdf), "m", "s", reverse=True).toPandas().sort_values("id")["s"].to_numpy()
    assert (rev == 6 - exp).all()


def test_first_rank_score_matches_qcut_of_rank_not_ntile(spark):
    # T5: qcut(rank(method='first')) differs from ntile for n = 7 and 12
    for n in (7, 12, 1500):
        freq = [1 + (i * 7919) % 4 for i in range(n)]
        pdf = pd.DataFrame({"id": range(n), "f": freq})
        got = first_rank_score(spark.createDataFrame(pdf), "f", "s", ["id"]).toPandas().sort_values("id")["s"].to_numpy()
        ranks = pdf.sort_values(["f", "id"]).assign(r=range(1, n + 1)).sort_values("id")["r"]
        exp = pd.qcut(ranks, 5, labels=[1, 2, 3, 4, 5]).astype(int).to_numpy()
        assert (got == exp).all(), n


def test_tied_edges_degrade_instead_of_failing(spark):
    # All-equal frequency collapses every edge; everyone lands in bin 1
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id int, f double")
    assert {r["s"] for r in quantile_score(df, "f", "s").collect()} == {1}


def test_bround_is_half_even(spark):
    # Pandas rounds half to even, SQL ROUND half away from zero
    r = spark.range(1).select(F.bround(F.lit(0.125), 2).alias("e"), F.round(F.lit(0.125), 2).alias("u")).first()
    assert r["e"] == 0.12 and r["u"] == 0.13


def test_clean_text_by_hand(spark):
    # White space is Unicode (nbsp splits words); accented letters are deleted, not folded
    samples = {"N\u00e3o gostei do produto!! http://x.y/z ok": "no gostei do produto ok",
               "\u00d3timo   PRODUTO, www.loja.com chegou": "timo produto chegou",
               "": "", "a\u00a0b\tc\nd": "a b c d", "caf\u00e9 cr\u00e8me br\u00fbl\u00e9e 123": "caf crme brle"}
    df = spark.createDataFrame([(s,) for s in [*samples, None]], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == [*samples.values(), ""]

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from martlens.operators.kernels import (
    box_stats, exact_median_columns, exact_quantiles, global_row_number, histogram, order_key, prefix_sum, top_k_per_group,
)


def _frame(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n),
                        "v": rng.integers(0, 40, n).astype(float), "w": rng.integers(0, 5, n)})
    return spark.createDataFrame(pdf), pdf


def test_prefix_sum_matches_cumsum(spark):
    df, pdf = _frame(spark)
    got = prefix_sum(df, ["v", "id"], "w", "before").toPandas().sort_values(["v", "id"])
    exp = pdf.sort_values(["v", "id"])
    assert (got["before"].to_numpy() == (exp["w"].cumsum() - exp["w"]).to_numpy()).all()


def test_global_row_number_is_a_permutation(spark):
    df, pdf = _frame(spark)
    got = global_row_number(df.repartition(7), ["v", "id"], "rn").toPandas().sort_values(["v", "id"])
    assert got["rn"].tolist() == list(range(1, len(pdf) + 1))


def test_exact_quantiles_match_numpy_linear(spark):
    df, pdf = _frame(spark)
    probs = [0.0, 0.2, 0.25, 0.5, 0.8, 0.995, 1.0]
    exp = np.percentile(pdf["v"], [p * 100 for p in probs])
    for parts in (None, 3):
        got = exact_quantiles(df, "v", probs).toPandas().iloc[0].to_numpy()
        assert np.allclose(got, exp, rtol=0, atol=1e-9)
        grouped = exact_quantiles(df, "v", [0.5, 0.99], by=["g"]).toPandas().set_index("g")
        for g, part in pdf.groupby("g"):
            assert np.allclose(grouped.loc[g].to_numpy(), np.percentile(part["v"], [50, 99]))


def test_quantiles_skip_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first()[0] == 1.5
    assert exact_quantiles(df, "x", [0.5]).first()[0] == 1.5


def test_median_fill_is_exact_not_imputer(spark):
    # Values 1, 2 -> 1.5 (MLlib Imputer would give 1.0)
    df = spark.createDataFrame([(1.0, 4.0), (2.0, None), (None, 6.0)], "a double, b double")
    row = exact_median_columns(df, ["a", "b"]).first()
    assert row["a"] == 1.5 and row["b"] == 5.0


def test_quantiles_do_not_depend_on_partitioning(spark):
    df, _ = _frame(spark, 300, 7)
    a = exact_quantiles(df.repartition(1), "v", [0.3, 0.7], num_partitions=1).first()
    b = exact_quantiles(df.repartition(17), "v", [0.3, 0.7], num_partitions=13).first()
    assert tuple(a) == tuple(b)


def test_histogram_counts_and_last_bin_closed(spark):
    df, pdf = _frame(spark)
    h = histogram(df, "v", 10).toPandas().sort_values("bin")
    assert h["count"].sum() == len(pdf)
    counts, _ = np.histogram(pdf["v"], bins=10)
    assert h["count"].tolist() == counts.tolist()
    # A single value (min = max) is widened by 0.5 each side, all rows in one bin
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h1 = histogram(one, "x", 4).toPandas()
    assert h1["count"].sum() == 2 and h1["bin_lo"].min() == 2.5 and h1["bin_hi"].max() == 3.5


def test_box_stats_against_numpy(spark):
    df, pdf = _frame(spark)
    row = box_stats(df, "v").first()
    q1, med, q3 = np.percentile(pdf["v"], [25, 50, 75])
    iqr = q3 - q1
    inside = pdf["v"][(pdf["v"] >= q1 - 1.5 * iqr) & (pdf["v"] <= q3 + 1.5 * iqr)]
    assert (row["q1"], row["median"], row["q3"]) == (q1, med, q3)
    assert row["whisker_lo"] == inside.min() and row["whisker_hi"] == inside.max()
    assert row["outliers"] == len(pdf) - len(inside)


def test_top_k_per_group_is_exact(spark):
    df, pdf = _frame(spark, 800, 3)
    got = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5, salt=["id"], buckets=6).toPandas()
    for g, part in pdf.groupby("g"):
        exp = part.sort_values(["v", "id"], ascending=[False, True]).head(5)["id"].tolist()
        assert got[got.g == g].sort_values("rank")["id"].tolist() == exp


def test_prefix_sum_keeps_wide_values(spark):
    """Nullable 64-bit values and far dates pass through untouched."""
    import datetime as dt

    rows = [(1, 9007199254740993, dt.datetime(2300, 1, 1)), (2, None, None), (3, -9007199254740993, dt.datetime(1, 1, 1))]
    df = spark.createDataFrame(rows, "id long, v long, t timestamp_ntz")
    got = prefix_sum(df, ["id"], ["id", "v"], ["a", "b"]).orderBy("id").collect()
    assert [tuple(r)[:3] for r in got] == [(i, v or 0, t) for i, v, t in rows]
    assert [(r.a, r.b) for r in got] == [(0, 0), (1, 9007199254740993), (3, 9007199254740993)]
    ranked = global_row_number(df, ["id"], "rn").orderBy("id").collect()
    assert [(r.v, r.t, r.rn) for r in ranked] == [(v, t, i) for i, v, t in rows]


def test_group_tables_beyond_the_broadcast_size(spark, monkeypatch):
    from martlens.operators import kernels

    df = spark.createDataFrame([(g, float(x)) for g in range(5) for x in range(g + 2)], "g int, v double")
    want = exact_quantiles(df, "v", [0.5], by=["g"]).orderBy("g").collect()
    monkeypatch.setattr(kernels, "BROADCAST_GROUPS", 2)
    assert exact_quantiles(df, "v", [0.5], by=["g"]).orderBy("g").collect() == want


def test_order_key_is_exact_for_every_kind_of_double(spark):
    """The key is the bits of |v|: for all powers of two, their neighbours, subnormals, zeros and infinities."""
    p = np.array([2.0 ** e for e in range(-1074, 1024)])
    rng = np.random.default_rng(3)
    some = rng.integers(0, 0x7FEF_FFFF_FFFF_FFFF, 20_000).view(np.float64)
    v = np.unique(np.concatenate((p, np.nextafter(p, 0), np.nextafter(p, np.inf), some, [0.0, np.inf, 1.7976931348623157e308])))
    v = np.concatenate((-v[::-1], v))
    bits = np.abs(v).view(np.int64)
    got = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "v": v})).select("i", order_key(F.col("v")).alias("k")).toPandas()
    assert (got.sort_values("i")["k"].to_numpy() == np.where(v < 0, -bits, bits)).all()


def test_quantiles_of_hard_values(spark):
    """All magnitudes, values that differ in the last bit, one value held by a third of all rows, infinities, weights."""
    rng = np.random.default_rng(4)
    base = 1234.5
    near = [base]
    for _ in range(300):
        near.append(np.nextafter(near[-1], np.inf))
    v = np.concatenate((rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500), near, np.full(400, 7.25), [0.0, -0.0, -5e-324, 5e-324]))
    w = rng.integers(1, 4, len(v))
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w, "g": np.arange(len(v)) % 2}))
    probs = [0.0, 0.1, 0.37, 0.5, 0.501, 0.9, 1.0]
    assert tuple(exact_quantiles(df, "v", probs).first()) == tuple(np.sort(v)[[0]]) + tuple(
        _linear(np.sort(v), p) for p in probs[1:])
    rep = np.sort(np.repeat(v, w))
    assert tuple(exact_quantiles(df, "v", probs, weight="w").first()) == tuple(_linear(rep, p) for p in probs)
    got = {r["g"]: tuple(r)[1:] for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    assert got == {g: tuple(_linear(np.sort(v[g::2]), p) for p in probs) for g in (0, 1)}


def _linear(s, p):
    h = p * (len(s) - 1)
    lo, hi = s[int(np.floor(h))], s[int(np.ceil(h))]
    return lo if lo == hi else lo + (hi - lo) * (h - np.floor(h))


def test_selection_sorts_and_writes_no_rows(spark):
    """No range exchange in the plan, whatever is selected."""
    df, _ = _frame(spark, 2000, 5)
    plan = exact_quantiles(df, "v", [0.5], by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_box_stats_of_no_rows(spark):
    r = box_stats(spark.createDataFrame([], "x double"), "x").first()
    assert r["n"] == 0 and r["median"] is None

import math

import numpy as np
from pyspark.sql import functions as F

from martlens.functions.stats import chi2_1df_sf, normal_sf, t_two_sided_p
from martlens.operators.experiment import chi_square_2x2, cohens_d, mann_whitney_u, moments, welch_t


def test_normal_and_chi2_tails_close_to_erfc(spark):
    zs = [-3.0, -1.2, 0.0, 0.5, 1.96, 4.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(normal_sf(F.col("z"))).collect()]
    for z, g in zip(zs, got):
        assert abs(g - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-7
    x = spark.createDataFrame([(3.84,)], "x double").select(chi2_1df_sf(F.col("x"))).first()[0]
    # twice the normal tail, so twice its 7.5e-8 error bound
    assert abs(x - math.erfc(math.sqrt(3.84 / 2))) < 1.5e-7


def test_t_tail_worked_values(spark):
    # df = 1 and 2 have closed forms; textbook t = 2.228 at df = 10 gives 0.05; t = 0 gives 1; large df is normal
    cases = [(2.228138851986274, 10.0, 0.05), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5), (12.706204736174698, 1.0, 0.05),
             (3.0, 2.0, 1 - 3 / math.sqrt(2 + 9)), (1.959963984540054, 1e7, 0.05), (1.9600, 9.9e5, 0.0499960),
             (-2.228138851986274, 10.0, 0.05)]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, d double")
    got = [r[0] for r in df.select(t_two_sided_p(F.col("t"), F.col("d"))).collect()]
    for g, (t, d, p) in zip(got, cases):
        assert abs(g - p) < (1e-9 if d < 100 else 1e-5), (t, d, g, p)
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0)], "t double, d double")
    assert [r[0] for r in odd.select(t_two_sided_p(F.col("t"), F.col("d"))).collect()] == [None] * 3


def _conv(spark, ca, na, cb, nb):
    return spark.createDataFrame([("A", na, ca, ca / na), ("B", nb, cb, cb / nb)],
                                 "arm string, assigned bigint, converted bigint, conversion_rate double")


def test_chi_square_yates_and_degenerate(spark):
    # [[30, 70], [45, 55]]: Yates chi2 by hand
    obs = np.array([[30, 70], [45, 55]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = obs + np.sign(exp - obs) * np.minimum(0.5, np.abs(exp - obs))
    chi = ((adj - exp) ** 2 / exp).sum()
    row = chi_square_2x2(_conv(spark, 30, 100, 45, 100)).first()
    assert abs(row["chi2"] - chi) < 1e-6 and abs(row["p_value"] - math.erfc(math.sqrt(chi / 2))) < 1e-6
    # Both arms converted 100% -> a zero expected cell -> p = 1, chi2 null
    deg = chi_square_2x2(_conv(spark, 50, 50, 60, 60)).first()
    assert deg["chi2"] is None and deg["p_value"] == 1.0


def _brute_mwu_less(a, b):
    allv = np.concatenate([a, b])
    order = np.argsort(allv, kind="mergesort")
    ranks = np.empty(len(allv))
    sv = allv[order]
    i = 0
    while i < len(sv):
        j = i
        while j + 1 < len(sv) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    n1, n2 = len(a), len(b)
    u1 = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    _, t = np.unique(allv, return_counts=True)
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (n1 * n2 - u1 - n1 * n2 / 2 - 0.5) / s
    return u1, z, 0.5 * math.erfc(z / math.sqrt(2))


def test_mann_whitney_against_brute_force(spark):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 30, 60) * 100
    b = rng.integers(5, 35, 70) * 100
    rows = [("A", int(x)) for x in a] + [("B", int(x)) for x in b]
    df = spark.createDataFrame(rows, "arm string, cents bigint")
    got = mann_whitney_u(df).first()
    u1, z, p = _brute_mwu_less(a, b)
    assert abs(got["u_stat"] - u1) < 1e-6 and abs(got["z"] - z) < 1e-6 and abs(got["p_value"] - p) < 1e-6
    # invariant: U1 + U2 = n1 n2 (swap the arms)
    sw = mann_whitney_u(df.withColumn("arm", F.when(F.col("arm") == "A", "B").otherwise("A"))).first()
    assert abs(got["u_stat"] + sw["u_stat"] - len(a) * len(b)) < 1e-6


def test_welch_t_against_formula(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(100, 900, 40)
    b = rng.integers(150, 950, 55)
    df = spark.createDataFrame([("A", int(x)) for x in a] + [("B", int(x)) for x in b], "arm string, cents bigint")
    row = welch_t(df, with_p=True).first()
    va, vb = np.var(a / 100, ddof=1), np.var(b / 100, ddof=1)
    t = (a.mean() / 100 - b.mean() / 100) / math.sqrt(va / len(a) + vb / len(b))
    dfree = (va / len(a) + vb / len(b)) ** 2 / ((va / len(a)) ** 2 / (len(a) - 1) + (vb / len(b)) ** 2 / (len(b) - 1))
    assert abs(row["t_stat"] - t) < 1e-5 and abs(row["df"] - dfree) < 1e-5
    one = spark.createDataFrame([(float(t), float(dfree))], "t double, d double").select(t_two_sided_p(F.col("t"), F.col("d"))).first()[0]
    assert abs(row["p_value"] - one) < 1e-6 and 0 < one < 1
    m = moments(df).where("arm = 'A'").first()
    assert abs(m["var"] - va) < 1e-9


def _values(spark, a, b):
    return spark.createDataFrame([("A", x) for x in a] + [("B", x) for x in b], "arm string, cents bigint")


def test_degenerate_arms_give_null(spark):
    flat, one, empty = _values(spark, [5, 5, 5], [5, 5]), _values(spark, [5], [7, 9]), _values(spark, [1, 2, 3], [])
    for v in (flat, one, empty):
        assert welch_t(v, with_p=True).first()["t_stat"] is None
    assert tuple(cohens_d(flat).first()) == (None, None) and tuple(cohens_d(empty).first()) == (None, None)
    assert mann_whitney_u(flat).first()["z"] is None and mann_whitney_u(empty).first()["p_value"] is None
    zero = _values(spark, [0, 0], [4, 6])
    assert zero.transform(moments).count() == 2
    from martlens.operators.experiment import aov_lift_of

    assert aov_lift_of(zero).first()["aov_lift_pct"] is None


def test_large_values_and_ties(spark):
    # a customer of 40 million units, and 4.3 million equal zeros
    big = welch_t(_values(spark, [4_000_000_000, 10, 20], [30, 40, 50])).first()
    assert abs(big["t_stat"] - 1.0) < 1e-4
    ties = spark.range(4_300_000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("arm"), F.lit(0).cast("bigint").alias("cents"))
    some = ties.unionByName(_values(spark, [1], [2]))
    r = mann_whitney_u(some).first()
    n = 2_150_001
    assert abs(r["u_stat"] - (n * n / 2 - 0.5)) < 1.0 and 0 <= r["p_value"] <= 1


def test_one_class_scores(spark):
    from martlens.operators.churn import auc, roc_points

    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "score double, label int")
    assert auc(df).first()["auc"] is None
    assert {r["fpr"] for r in roc_points(df).collect()} == {0.0, None}


def test_exact_u_against_all_orders(spark):
    """Small arms without ties: the share of all orders with so small a U; ties or a large arm: the approximation."""
    import itertools

    rng = np.random.default_rng(8)
    for n1, n2 in ((1, 1), (3, 5), (8, 8), (8, 2)):
        v = rng.permutation(n1 + n2)
        df = spark.createDataFrame([("A" if i < n1 else "B", int(x)) for i, x in enumerate(v)], "arm string, cents long")
        u = sum(int(a) > int(b) for a in v[:n1] for b in v[n1:])
        all_u = [sum(r) - n1 * (n1 - 1) // 2 for r in itertools.combinations(range(n1 + n2), n1)]
        got = mann_whitney_u(df).first()
        assert got["u_stat"] == u and got["p_value"] == round(sum(x <= u for x in all_u) / len(all_u), 6)
    tied = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3)], "arm string, cents long")
    assert mann_whitney_u(tied).first()["p_value"] not in (None, round(1 / 6, 6))


def test_auc_and_bends_per_group(spark):
    """All groups in one pass equal one pass a group; the dropped points lie on the line between kept ones."""
    from martlens.operators.churn import auc, roc_points

    rng = np.random.default_rng(9)
    rows = [(g, int(rng.random() < 0.4), float(rng.integers(0, 30 * (g + 1)) / 10)) for g in range(4) for _ in range(200)]
    rows += [(9, 1, 0.5), (9, 1, 0.7)]  # one class only
    df = spark.createDataFrame(rows, "g int, label int, score double").repartition(5)
    got = {r["g"]: r["auc"] for r in auc(df, by=["g"]).collect()}
    assert got == {g: auc(df.where(F.col("g") == g)).first()["auc"] for g in (0, 1, 2, 3, 9)} and got[9] is None
    bends = roc_points(df, by=["g"], drop_collinear=True).where("g < 9").collect()
    for g in range(4):
        full = sorted((r["fpr"], r["tpr"]) for r in roc_points(df.where(F.col("g") == g)).collect())
        kept = sorted((r["fpr"], r["tpr"]) for r in bends if r["g"] == g)
        assert set(kept) <= set(full) and len(kept) < len(full)
        x, y = zip(*full)
        assert np.allclose(np.interp(x, *zip(*kept)), y, atol=1e-5) or len(set(x)) < len(x)


def test_neighbours_across_ranges(spark):
    from martlens.operators.kernels import neighbours, prefix_sum

    df = prefix_sum(spark.range(100).select(F.col("id").alias("v")), ["v"], None, "b", 7, keep_partition="p")
    got = {r["v"]: (r["_prev"], r["_next"]) for r in neighbours(df, "p", ["v"], ["v"]).collect()}
    assert df.select("p").distinct().count() > 3
    assert all((p["v"] if p else None, n["v"] if n else None) == (v - 1 if v else None, v + 1 if v < 99 else None) for v, (p, n) in got.items())


def test_round_bins(spark):
    from martlens.operators.kernels import round_histogram

    df = spark.createDataFrame([(float(x),) for x in (3, 3, 17, 61, 99)], "v double")
    got = [tuple(r) for r in round_histogram(df, "v", 12).orderBy("bin_lo").collect()]
    assert got == [(float(x), float(x + 10), {0: 2, 10: 1, 60: 1, 90: 1}.get(x, 0)) for x in range(0, 100, 10)]
    assert [tuple(r) for r in round_histogram(df.where("v = 17"), "v", 12).collect()] == [(17.0, 18.0, 1)]
    assert round_histogram(df.where("false"), "v", 12).count() == 0

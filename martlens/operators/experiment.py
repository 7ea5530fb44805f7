"""Two-arm experiment over customers.

Randomness is md5 of (salt, key): the same on every run, partitioning and
engine.  Money is carried as integer cents, so sums, variances (from exact
integer moments) and lifts do not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_int, md5_key
from ..functions.stats import Z_ALPHA_975, Z_POWER_80, chi2_1df_sf, normal_sf, t_two_sided_p
from ..session import cut_lineage
from .kernels import box_stats, exact_quantiles, global_row_number, histogram, with_row

KEY = "customer_unique_id"
ROW_KEYS = ["order_id", "order_item_id", "product_id", "payment_sequential"]
SALT_ARM, SALT_UPLIFT, SALT_EXTRA, SALT_TARGET = "arm", "uplift", "extra", "target"
# Fixed values of the simulated campaign: uplift factor range, share of control rows copied.
UPLIFT_LO, UPLIFT_HI = 1.04, 1.12
EXTRA_SHARE = 0.04
ALPHA = 0.05


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def arm_complement(ids: DataFrame, arm_ids: DataFrame, key: str = KEY) -> DataFrame:
    """Ids not in ``arm_ids`` (anti-join, distinct)."""
    return ids.join(arm_ids.select(key), key, "left_anti").distinct()


def assign_arms(ids: DataFrame, salt: str = SALT_ARM, key: str = KEY) -> DataFrame:
    """Control 'A' = the first floor(n/2) distinct ids in md5(salt|id) order
    (an exact-size draw without replacement), treatment 'B' = the rest."""
    u = ids.select(key).distinct()
    ranked = global_row_number(u.withColumn("_h", md5_key(salt, key)), ["_h", key], "_rn")
    n = u.agg(F.count(F.lit(1))).scalar()
    control = ranked.where(F.col("_rn") <= F.floor(n / 2)).select(key)
    treatment = arm_complement(u, control, key)
    return control.withColumn("arm", F.lit("A")).unionByName(treatment.withColumn("arm", F.lit("B")))


def arm_rows(fact: DataFrame, arms: DataFrame, key: str = KEY) -> DataFrame:
    """Fact rows of assigned customers, tagged with their arm."""
    return fact.join(arms, key)


def apply_uplift(rows: DataFrame, salt: str = SALT_UPLIFT, lo: float = UPLIFT_LO, hi: float = UPLIFT_HI) -> DataFrame:
    """Cents * factor, factor uniform in [lo, hi) on a 1e-8 grid from md5 of
    the row key, rounded half-up to a cent (integer arithmetic)."""
    k = md5_int(salt, *ROW_KEYS)
    lo_i, span_i = int(round(lo * 1e8)), int(round((hi - lo) * 1e8))
    factor = f"({lo_i} + ({span_i} * _k) div 4294967296)"
    return (rows.withColumn("_k", k)
            .withColumn("cents", F.expr(f"(cents * {factor} + 50000000) div 100000000"))
            .drop("_k"))


def sample_fraction_rows(rows: DataFrame, fraction: float, salt: str) -> DataFrame:
    """Rows whose md5 uniform is below ``fraction`` (integer threshold on 32 bits)."""
    threshold = int(-(-fraction * 4294967296 // 1))  # ceil
    return rows.where(md5_int(salt, *ROW_KEYS) < F.lit(threshold))


def inject_orders(control_rows: DataFrame, treatment_ids: DataFrame, fraction: float = EXTRA_SHARE,
                  salt_pick: str = SALT_EXTRA, salt_target: str = SALT_TARGET, key: str = KEY) -> DataFrame:
    """Copy a md5 sample of control rows to treatment customers picked by
    md5(row key) mod (number of treatment ids); ids numbered by a global rank."""
    picked = sample_fraction_rows(control_rows, fraction, salt_pick)
    numbered = global_row_number(treatment_ids.select(key), [key], "_tn").withColumn("_tn", F.col("_tn") - 1)
    nt = treatment_ids.agg(F.count(F.lit(1))).scalar()
    picked = picked.withColumn("_tn", F.pmod(md5_int(salt_target, *ROW_KEYS), nt))
    return (picked.drop(key).join(numbered, "_tn").drop("_tn")
            .withColumn("arm", F.lit("B")).withColumn("origin", F.lit("injected")))


def experiment_rows(fact: DataFrame, arms: DataFrame, key: str = KEY) -> DataFrame:
    """X1 -> J4 -> X2 -> X3 -> U1: (arm, customer, row keys, cents, origin)."""
    rows = arm_rows(fact.select(key, *ROW_KEYS, _cents("price").alias("cents")), arms, key)
    control = rows.where(F.col("arm") == "A").withColumn("origin", F.lit("base"))
    treated = apply_uplift(rows.where(F.col("arm") == "B")).withColumn("origin", F.lit("base"))
    extra = inject_orders(control, arms.where(F.col("arm") == "B").select(key), key=key)
    cols = ["arm", key, *ROW_KEYS, "cents", "origin"]
    return control.select(*cols).unionByName(treated.select(*cols)).unionByName(extra.select(*cols))


# ---- metrics ---------------------------------------------------------------------

def conversion(rows: DataFrame, arms: DataFrame, key: str = KEY) -> DataFrame:
    """Per arm, assigned ids, ids with a purchase, and their ratio."""
    assigned = arms.groupBy("arm").agg(F.count(F.lit(1)).cast("bigint").alias("assigned"))
    buyers = rows.select("arm", key).distinct().groupBy("arm").agg(F.count(F.lit(1)).cast("bigint").alias("converted"))
    j = assigned.join(buyers, "arm", "left").withColumn("converted", F.coalesce("converted", F.lit(0)).cast("bigint"))
    return j.withColumn("conversion_rate", F.col("converted") / F.col("assigned"))


def _wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-row (arm A, arm B) frame to one row with _A / _B suffixes."""
    aggs = []
    for c in cols:
        aggs.append(F.max(F.when(F.col("arm") == "A", F.col(c))).alias(f"{c}_A"))
        aggs.append(F.max(F.when(F.col("arm") == "B", F.col(c))).alias(f"{c}_B"))
    return df.groupBy().agg(*aggs)


def chi_square_2x2(conv: DataFrame) -> DataFrame:
    """Yates-corrected chi-square of [[conv A, not A], [conv B, not B]];
    a zero expected cell gives chi2 null and p = 1 (the test cannot run)."""
    w = _wide(conv, ["assigned", "converted"])
    cA, cB = F.col("converted_A").cast("double"), F.col("converted_B").cast("double")
    nA, nB = F.col("assigned_A").cast("double"), F.col("assigned_B").cast("double")
    cells = [(cA, nA, cA + cB), (nA - cA, nA, nA + nB - cA - cB), (cB, nB, cA + cB), (nB - cB, nB, nA + nB - cA - cB)]
    total = nA + nB
    exp = [F.try_divide(row * col, total) for _, row, col in cells]
    zero = None
    chi = None
    for (o, _, _), e in zip(cells, exp):
        d = e - o
        adj = o + F.signum(d) * F.least(F.lit(0.5), F.abs(d))
        term = F.try_divide((adj - e) * (adj - e), e)
        chi = term if chi is None else chi + term
        z = F.coalesce(e == 0, F.lit(True))
        zero = z if zero is None else (zero | z)
    chi2 = F.when(zero, F.lit(None).cast("double")).otherwise(chi)
    return w.select(F.round(chi2, 6).alias("chi2"),
                    F.when(zero, F.lit(1.0)).otherwise(F.round(chi2_1df_sf(chi), 6)).alias("p_value"),
                    F.lit(1).cast("bigint").alias("dof"))


def order_values(rows: DataFrame) -> DataFrame:
    """Price sum per (arm, order id)."""
    return rows.groupBy("arm", "order_id").agg(F.sum("cents").cast("bigint").alias("cents"))


def customer_revenue(rows: DataFrame, arms: DataFrame, key: str = KEY) -> DataFrame:
    """A22 + J6: price sum per assigned customer of each arm, 0 when absent."""
    s = rows.groupBy("arm", key).agg(F.sum("cents").alias("_c"))
    return arms.join(s, ["arm", key], "left").select("arm", key, F.coalesce("_c", F.lit(0)).cast("bigint").alias("cents"))


def moments(values: DataFrame, col: str = "cents") -> DataFrame:
    """Per arm: n, sum, mean and sample variance (exact integer moments, in currency units)."""
    x = F.col(col)
    m = values.groupBy("arm").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum(x.cast("decimal(38,0)")).alias("_s1"),
        F.sum(x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).alias("_s2"))
    n, s1, s2 = F.col("n").cast("decimal(20,0)"), F.col("_s1"), F.col("_s2")
    # exact while the products fit 38 digits, in double beyond
    exact = F.try_subtract(F.try_multiply(n, s2).cast("decimal(38,0)"), F.try_multiply(s1, s1).cast("decimal(38,0)"))
    d1 = s1.cast("double")
    num = F.coalesce(exact.cast("double"), n.cast("double") * s2.cast("double") - d1 * d1)
    pairs = F.col("n").cast("double") * (F.col("n") - 1).cast("double")
    return m.select("arm", "n", (d1 / F.col("n") / F.lit(100.0)).alias("mean"),
                    (F.try_divide(num, pairs) / F.lit(10000.0)).alias("var"))


def lift(a: Column, b: Column) -> Column:
    """Relative change in per cent; null when the base is zero."""
    return F.try_divide(b - a, a) * F.lit(100.0)


def aov_lift(rows: DataFrame) -> DataFrame:
    """Mean order value per arm and relative lift (%)."""
    return aov_lift_of(order_values(rows))


def aov_lift_of(values: DataFrame) -> DataFrame:
    w = _wide(moments(values), ["mean"])
    return w.select(F.round("mean_A", 6).alias("mean_aov_A"), F.round("mean_B", 6).alias("mean_aov_B"),
                    F.round(lift(F.col("mean_A"), F.col("mean_B")), 6).alias("aov_lift_pct"))


def welch_t(values: DataFrame, with_p: bool = False) -> DataFrame:
    """Welch t of arm A against arm B (A - B), Welch-Satterthwaite df; p two-sided.

    Null without variance in both arms, with fewer than two values in an arm, or with an empty arm."""
    w = _wide(moments(values), ["n", "mean", "var"])
    sa = F.col("var_A") / F.col("n_A")
    sb = F.col("var_B") / F.col("n_B")
    t = F.try_divide(F.col("mean_A") - F.col("mean_B"), F.sqrt(sa + sb))
    df = F.try_divide((sa + sb) * (sa + sb), F.try_divide(sa * sa, F.col("n_A") - 1) + F.try_divide(sb * sb, F.col("n_B") - 1))
    out = w.select(t.alias("t_stat"), df.alias("df"))
    if with_p:
        out = out.withColumn("p_value", F.round(t_two_sided_p(F.col("t_stat"), F.col("df")), 6))
    return out.select(*[F.round(c, 6).alias(c) if c != "p_value" else F.col(c) for c in out.columns])


def revenue_lift(cust: DataFrame) -> DataFrame:
    """Mean revenue per assigned customer per arm and relative lift (%)."""
    w = _wide(moments(cust), ["mean"])
    return w.select(F.round("mean_A", 6).alias("mean_rev_A"), F.round("mean_B", 6).alias("mean_rev_B"),
                    F.round(lift(F.col("mean_A"), F.col("mean_B")), 6).alias("rev_lift_pct"))


#: Arms of at most so many values without ties get the exact null distribution of U.
EXACT_ARM = 8


def exact_u_tail(u: Column, n1: Column, n2: Column) -> Column:
    """P(U <= u) under the null for small arms: in how many of the orders of n1 + n2 values U is at most u.

    The number of orders with a given U is the coefficient of q^U in the product of (1 - q^(n2 + i)) / (1 - q^i), i = 1..n1,
    built factor by factor on an array of n1 n2 + 1 counts."""
    size = (n1 * n2 + 1).cast("int")
    one = F.transform(F.sequence(F.lit(1), size), lambda k: F.when(k == 1, 1.0).otherwise(0.0))

    def factor(c, i):
        shift = (n2 + i).cast("int")
        less = F.transform(c, lambda x, k: x - F.when(k >= shift, F.get(c, k - shift)).otherwise(0.0))  # times 1 - q^(n2 + i)
        grown = F.aggregate(less, F.array().cast("array<double>"), lambda a, x: F.concat(  # divided by 1 - q^i
            a, F.array(x + F.coalesce(F.get(a, F.size(a) - i), F.lit(0.0)))))
        return grown

    counts = F.aggregate(F.sequence(F.lit(1), n1.cast("int")), one, factor)
    return F.aggregate(F.slice(counts, F.lit(1), F.floor(u).cast("int") + 1), F.lit(0.0), lambda a, x: a + x) / F.aggregate(
        counts, F.lit(0.0), lambda a, x: a + x)


def mann_whitney_u(values: DataFrame, col: str = "cents") -> DataFrame:
    """U of arm A, one-sided 'less' (A stochastically smaller), normal
    approximation with tie correction and continuity correction; exact for
    arms of at most EXACT_ARM values each without ties.

    Average ranks come from a global prefix sum over distinct values, so tied
    values (e.g. every customer with revenue 0) are one row."""
    vc = values.groupBy(F.col(col).alias("_v")).agg(
        F.count(F.lit(1)).alias("_t"), F.sum(F.when(F.col("arm") == "A", 1).otherwise(0)).alias("_ta"))
    from .kernels import prefix_sum

    cum = prefix_sum(vc, ["_v"], "_t", "_before")
    twice = (2 * F.col("_before") + F.col("_t") + 1).cast("decimal(19,0)")  # of the average rank
    t = F.col("_t").cast("double")
    s = cum.agg(
        (F.sum(F.col("_ta").cast("decimal(19,0)") * twice).cast("double") / 2.0).alias("r1"),
        F.sum("_ta").cast("double").alias("n1"),
        (F.sum("_t") - F.sum("_ta")).cast("double").alias("n2"),
        F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u2 = n1 * n2 - u1
    sd = F.sqrt(F.greatest(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))), F.lit(0.0)))
    z = F.try_divide(u2 - n1 * n2 / 2.0 - 0.5, sd)  # null when all values tie or an arm is empty
    small = (n1.between(1, EXACT_ARM)) & (n2.between(1, EXACT_ARM)) & (F.col("ties") == 0)
    p = F.when(small, exact_u_tail(u1, n1, n2)).when(z.isNotNull(), F.least(F.greatest(normal_sf(z), F.lit(0.0)), F.lit(1.0)))
    return s.select(F.round(u1, 6).alias("u_stat"), F.round(z, 6).alias("z"), F.round(p, 6).alias("p_value"))


def cohens_d(cust: DataFrame) -> DataFrame:
    """(mean B - mean A) / sqrt((sd A^2 + sd B^2) / 2), with the size band."""
    w = _wide(moments(cust), ["mean", "var"])
    d = F.try_divide(F.col("mean_B") - F.col("mean_A"), F.sqrt((F.col("var_A") + F.col("var_B")) / 2.0))
    band = F.when(d.isNull(), F.lit(None).cast("string")).when(F.abs(d) < 0.2, "Small").when(F.abs(d) < 0.5, "Medium").otherwise("Large")
    return w.select(F.round(d, 6).alias("cohens_d"), band.alias("effect"))


def required_sample_size(conv: DataFrame) -> DataFrame:
    """X11: n per arm to detect p1 -> p2 at alpha .05 two-sided, power .80;
    the squared difference is floored at 1e-10; truncated to an integer."""
    w = _wide(conv, ["assigned", "conversion_rate"])
    p1, p2 = F.col("conversion_rate_A"), F.col("conversion_rate_B")
    pbar = (p1 + p2) / 2.0
    top = F.lit(Z_ALPHA_975) * F.sqrt(2.0 * pbar * (1.0 - pbar)) + F.lit(Z_POWER_80) * F.sqrt(p1 * (1.0 - p1) + p2 * (1.0 - p2))
    req = F.floor(F.lit(2.0) * (top * top) / F.greatest((p2 - p1) * (p2 - p1), F.lit(1e-10))).cast("bigint")
    actual = F.floor((F.col("assigned_A") + F.col("assigned_B")) / 2).cast("bigint")
    return w.select(req.alias("required_n"), actual.alias("actual_per_group"), (actual >= req).alias("powered"))


def ab_summary(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """One row: sizes, lifts, p values, effect size, launch advice
    (conversion and order-value p both below .05; revenue p is not used)."""
    conv = cut_lineage(conversion(rows, arms), "conversion")
    orders, cust = cut_lineage(order_values(rows), "order-values"), cut_lineage(customer_revenue(rows, arms), "customer-revenue")
    cw = _wide(conv, ["assigned", "conversion_rate"])
    parts = [
        cw.select(F.col("assigned_A").alias("n_control"), F.col("assigned_B").alias("n_treatment"),
                  F.round((F.col("conversion_rate_B") - F.col("conversion_rate_A")) * 100.0, 6).alias("conversion_lift_pts"),
                  F.round(lift(F.col("conversion_rate_A"), F.col("conversion_rate_B")), 6).alias("conversion_lift_pct")),
        chi_square_2x2(conv).select(F.col("p_value").alias("p_conv")),
        aov_lift_of(orders).select("aov_lift_pct"),
        welch_t(orders, with_p=True).select(F.col("p_value").alias("p_aov")),
        revenue_lift(cust).select("rev_lift_pct"),
        mann_whitney_u(cust).select(F.col("p_value").alias("p_rev")),
        cohens_d(cust),
        required_sample_size(conv).select("required_n", "powered"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = with_row(out, p)
    launch = (F.col("p_conv") < ALPHA) & (F.col("p_aov") < ALPHA)
    return out.withColumn("launch", launch)


def lift_table(summary: DataFrame) -> DataFrame:
    """Metric, relative lift %, p value and significance, one row per metric."""
    return summary.select(F.explode(F.array(
        F.struct(F.lit("conversion").alias("metric"), F.col("conversion_lift_pct").alias("lift_pct"), F.col("p_conv").alias("p_value")),
        F.struct(F.lit("order_value").alias("metric"), F.col("aov_lift_pct").alias("lift_pct"), F.col("p_aov").alias("p_value")),
        F.struct(F.lit("revenue").alias("metric"), F.col("rev_lift_pct").alias("lift_pct"), F.col("p_rev").alias("p_value")),
    )).alias("m")).select("m.*").withColumn("significant", F.col("p_value") < ALPHA)


def order_value_histogram(rows: DataFrame, bins: int = 40, q: float = 0.99) -> DataFrame:
    """Per arm, order values winsorised at the arm's q-quantile, density histogram."""
    from .clean import clip_at_quantile

    # written: the edge, the ranges and the counts each read it
    ov = cut_lineage(order_values(rows).select("arm", (F.col("cents") / F.lit(100.0)).alias("value")), "order-values")
    clipped = clip_at_quantile(ov, "value", q, by=["arm"])
    return histogram(clipped, "value", bins, by=["arm"], density=True)


def revenue_box_stats(cust: DataFrame, q: float = 0.98) -> DataFrame:
    """A27 (U4): revenue per customer, rows above the q-quantile of both arms dropped, box numbers per arm.

    Customers are counted by arm and amount once; the edge and the quartiles are selected from those counts."""
    v = cut_lineage(cust.groupBy("arm", (F.col("cents") / F.lit(100.0)).alias("revenue")).agg(F.count(F.lit(1)).alias("n")), "revenue-counts")
    edge = exact_quantiles(v, "revenue", [q], names=["_edge"], weight="n").select("_edge").scalar()
    return box_stats(v.where(F.col("revenue") <= edge), "revenue", by=["arm"], weight="n")

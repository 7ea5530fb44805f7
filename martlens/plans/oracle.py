"""DuckDB oracle SQL per query name (same output column names as the Spark side)."""

from __future__ import annotations

from .oracle_base import cte, md5_int_sql, md5_sql, md5_unit_sql, with_ctes  # noqa: F401

ORACLE: dict[str, str] = {}


BODY: dict[str, str] = {}


def oracle(name: str, body: str, *ctes: str) -> None:
    BODY[name] = body
    ORACLE[name] = with_ctes(body, *ctes)


oracle("monthly_revenue", """
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month,
       CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM fact GROUP BY 1""", "fact")


oracle("wide_fact", "SELECT * FROM wide", "wide")

oracle("item_fact", """
WITH it AS (SELECT DISTINCT * FROM fx_order_items),
pay AS (SELECT order_id, count(*) AS payment_count,
          CAST(sum(CAST(payment_value AS DECIMAL(18,2))) AS DOUBLE) AS payment_value,
          CAST(max(payment_installments) AS BIGINT) AS payment_installments,
          arg_min(payment_type, payment_sequential) AS payment_type
        FROM fx_payments GROUP BY order_id)
SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
  o.order_delivered_customer_date, o.order_estimated_delivery_date,
  it.order_item_id, it.product_id, it.price, it.freight_value,
  pay.payment_count, pay.payment_type, pay.payment_installments, pay.payment_value,
  c.customer_unique_id, c.customer_state, pr.product_category_name, ct.product_category_name_english
FROM fx_orders o
LEFT JOIN it ON o.order_id = it.order_id
LEFT JOIN pay ON o.order_id = pay.order_id
LEFT JOIN fx_customers c ON o.customer_id = c.customer_id
LEFT JOIN fx_products pr ON it.product_id = pr.product_id
LEFT JOIN fx_category_translation ct ON pr.product_category_name = ct.product_category_name""",
       "fx_orders", "fx_order_items", "fx_payments", "fx_customers", "fx_products", "fx_category_translation")

oracle("join_key_checks", """
SELECT 'customers' AS table_name, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(DISTINCT customer_id) AS BIGINT) AS distinct_keys,
       count(*) = count(DISTINCT customer_id) AS "unique" FROM fx_customers
UNION ALL
SELECT 'products', count(*), count(DISTINCT product_id), count(*) = count(DISTINCT product_id) FROM fx_products
UNION ALL
SELECT 'category', count(*), count(DISTINCT product_category_name),
       count(*) = count(DISTINCT product_category_name) FROM fx_category_translation
UNION ALL
SELECT 'order_items', count(*), (SELECT count(*) FROM (SELECT DISTINCT order_id, order_item_id FROM fx_order_items)),
       count(*) = (SELECT count(*) FROM (SELECT DISTINCT order_id, order_item_id FROM fx_order_items))
FROM fx_order_items""", "fx_customers", "fx_products", "fx_category_translation", "fx_order_items")

oracle("dedup_report", """
SELECT CAST((SELECT count(*) FROM wide_all) AS BIGINT) AS rows_before,
       CAST((SELECT count(*) FROM wide) AS BIGINT) AS rows_after,
       CAST((SELECT count(*) FROM wide_all) - (SELECT count(*) FROM wide) AS BIGINT) AS removed""",
       "wide_all", "wide")

oracle("null_profile", """
WITH u AS (
  UNPIVOT (SELECT
    count(*) FILTER (WHERE order_id IS NULL) AS order_id,
    count(*) FILTER (WHERE customer_id IS NULL) AS customer_id,
    count(*) FILTER (WHERE order_status IS NULL) AS order_status,
    count(*) FILTER (WHERE order_purchase_timestamp IS NULL) AS order_purchase_timestamp,
    count(*) FILTER (WHERE order_approved_at IS NULL) AS order_approved_at,
    count(*) FILTER (WHERE order_delivered_customer_date IS NULL) AS order_delivered_customer_date,
    count(*) FILTER (WHERE order_estimated_delivery_date IS NULL) AS order_estimated_delivery_date,
    count(*) FILTER (WHERE order_item_id IS NULL) AS order_item_id,
    count(*) FILTER (WHERE product_id IS NULL) AS product_id,
    count(*) FILTER (WHERE price IS NULL) AS price,
    count(*) FILTER (WHERE freight_value IS NULL) AS freight_value,
    count(*) FILTER (WHERE payment_sequential IS NULL) AS payment_sequential,
    count(*) FILTER (WHERE payment_type IS NULL) AS payment_type,
    count(*) FILTER (WHERE payment_installments IS NULL) AS payment_installments,
    count(*) FILTER (WHERE payment_value IS NULL) AS payment_value,
    count(*) FILTER (WHERE customer_unique_id IS NULL) AS customer_unique_id,
    count(*) FILTER (WHERE customer_state IS NULL) AS customer_state,
    count(*) FILTER (WHERE product_category_name IS NULL) AS product_category_name,
    count(*) FILTER (WHERE product_category_name_english IS NULL) AS product_category_name_english
  FROM wide) ON COLUMNS(*) INTO NAME column_name VALUE nulls)
SELECT column_name, CAST(nulls AS BIGINT) AS nulls,
       round_even(nulls * 100.0 / (SELECT count(*) FROM wide), 2) AS null_pct
FROM u WHERE nulls > 0""", "wide")

oracle("table_shape", """
SELECT 'orders' AS table_name, CAST(count(*) AS BIGINT) AS rows, CAST(7 AS BIGINT) AS columns FROM fx_orders
UNION ALL SELECT 'order_items', count(*), 5 FROM fx_order_items
UNION ALL SELECT 'payments', count(*), 5 FROM fx_payments
UNION ALL SELECT 'customers', count(*), 3 FROM fx_customers
UNION ALL SELECT 'products', count(*), 2 FROM fx_products
UNION ALL SELECT 'category', count(*), 2 FROM fx_category_translation""",
       "fx_orders", "fx_order_items", "fx_payments", "fx_customers", "fx_products", "fx_category_translation")

oracle("preview_orders", """
SELECT order_id, customer_id, order_status FROM fx_orders ORDER BY order_id LIMIT 3""", "fx_orders")

oracle("clean_fact", "SELECT * FROM fact", "fact")

oracle("delivery_days_in_range", """
SELECT delivery_days, count(*) AS rows FROM fact
WHERE delivery_days IS NOT NULL AND delivery_days BETWEEN 0 AND 60 GROUP BY delivery_days""", "fact")

oracle("monthly_orders", """
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, CAST(count(DISTINCT order_id) AS BIGINT) AS orders
FROM fact GROUP BY 1""", "fact")

oracle("rows_by_weekday", """
WITH days AS (SELECT * FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'),
                                    (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) AS t(day_index, day)),
c AS (SELECT dayname(order_purchase_timestamp) AS day, count(*) AS orders, count(DISTINCT order_id) AS distinct_orders
      FROM fact GROUP BY 1)
SELECT days.day_index, days.day, CAST(c.orders AS BIGINT) AS orders, CAST(c.distinct_orders AS BIGINT) AS distinct_orders
FROM days LEFT JOIN c ON days.day = c.day""", "fact")

oracle("rows_by_hour", """
SELECT CAST(hour(order_purchase_timestamp) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS order_count
FROM fact GROUP BY 1 ORDER BY 1""", "fact")

oracle("revenue_by_payment", """
SELECT payment_type AS payment, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM fact WHERE payment_type IS NOT NULL GROUP BY 1""", "fact")

oracle("payment_breakdown", """
SELECT payment_type, CAST(count(*) AS BIGINT) AS count,
       CAST(round(sum(CAST(payment_value AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_value
FROM fact GROUP BY payment_type ORDER BY count DESC""", "fact")

oracle("kpis", """
SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
       CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS total_customers,
       round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT order_id), 6) AS avg_order_value
FROM fact""", "fact")

oracle("top_categories", """
SELECT product_category_name_english AS category, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM fact GROUP BY 1 ORDER BY revenue DESC, category LIMIT 10""", "fact")

oracle("top_states", """
SELECT customer_state, CAST(round(sum(CAST(price AS DECIMAL(18,2))), 2) AS DOUBLE) AS revenue,
       CAST(count(DISTINCT order_id) AS BIGINT) AS orders
FROM fact GROUP BY customer_state ORDER BY revenue DESC, customer_state LIMIT 10""", "fact")

oracle("cumulative_revenue", """
WITH m AS (SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, sum(CAST(price AS DECIMAL(18,2))) AS rev
           FROM fact GROUP BY 1)
SELECT month, CAST(rev AS DOUBLE) AS revenue,
       CAST(sum(rev) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative
FROM m""", "fact")


def histogram_sql(source: str, col: str, bins: int, where: str = "TRUE") -> str:
    n = float(bins)
    return f"""
WITH hv AS (SELECT CAST({col} AS DOUBLE) AS v FROM {source} WHERE {col} IS NOT NULL AND ({where})),
hs AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(*) AS n FROM hv),
hb AS (SELECT CAST(least(floor(CAST({n} AS DOUBLE) * (hv.v - hs.lo) / (hs.hi - hs.lo)) + 1, {bins}) AS BIGINT) AS bin,
              count(*) AS c FROM hv, hs GROUP BY 1),
hg AS (SELECT CAST(range AS BIGINT) AS bin FROM range(1, {bins + 1}))
SELECT hg.bin, round(hs.lo + (hs.hi - hs.lo) * (hg.bin - 1) / CAST({n} AS DOUBLE), 6) AS bin_lo,
       round(hs.lo + (hs.hi - hs.lo) * hg.bin / CAST({n} AS DOUBLE), 6) AS bin_hi,
       CAST(coalesce(hb.c, 0) AS BIGINT) AS count
FROM hg CROSS JOIN hs LEFT JOIN hb ON hg.bin = hb.bin"""


oracle("price_histogram", histogram_sql("fact", "price", 60), "fact")
oracle("delivery_histogram", histogram_sql("fact", "delivery_days", 40, "delivery_days BETWEEN 0 AND 60"), "fact")

oracle("price_freight_sample", f"""
SELECT order_id, order_item_id, product_id, payment_sequential, price, freight_value FROM fact
ORDER BY {md5_sql('price-freight', 'order_id', 'order_item_id', 'product_id', 'payment_sequential')},
         order_id, order_item_id, product_id, payment_sequential, price, freight_value
LIMIT 2000""", "fact")


SNAP = "TIMESTAMP '2001-08-02 00:00:00'"
RFM_BASE = f"""
SELECT customer_unique_id,
       CAST(floor(epoch({SNAP} - max(order_purchase_timestamp)) / 86400) AS BIGINT) AS recency,
       CAST(count(DISTINCT order_id) AS BIGINT) AS frequency,
       CAST(round(sum(CAST(price AS DECIMAL(18,2))), 2) AS DOUBLE) AS monetary
FROM fact WHERE order_purchase_timestamp < {SNAP} GROUP BY customer_unique_id"""

oracle("rfm_base", RFM_BASE, "fact")

RFM_SCORED = f"""
WITH rfm AS ({RFM_BASE}),
e AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS er,
             quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS em, count(*) AS n FROM rfm),
rk AS (SELECT rfm.*, row_number() OVER (ORDER BY frequency, customer_unique_id) AS rn FROM rfm),
sc AS (
  SELECT rk.customer_unique_id, rk.recency, rk.frequency, rk.monetary,
    CAST(6 - (1 + CAST(rk.recency > e.er[1] AS INT) + CAST(rk.recency > e.er[2] AS INT)
                + CAST(rk.recency > e.er[3] AS INT) + CAST(rk.recency > e.er[4] AS INT)) AS BIGINT) AS R_score,
    CAST(CASE WHEN rk.rn = 1 OR e.n <= 1 THEN 1 ELSE (5 * (rk.rn - 1) + e.n - 2) // (e.n - 1) END AS BIGINT) AS F_score,
    CAST(1 + CAST(rk.monetary > e.em[1] AS INT) + CAST(rk.monetary > e.em[2] AS INT)
           + CAST(rk.monetary > e.em[3] AS INT) + CAST(rk.monetary > e.em[4] AS INT) AS BIGINT) AS M_score
  FROM rk, e),
seg AS (
  SELECT sc.*, R_score + F_score + M_score AS RFM_score,
    CASE WHEN R_score + F_score + M_score >= 13 THEN 'Champions'
         WHEN R_score + F_score + M_score >= 10 THEN 'Loyal Customers'
         WHEN R_score + F_score + M_score >= 7 THEN 'Potential Loyalists'
         WHEN R_score + F_score + M_score >= 5 THEN 'At Risk' ELSE 'Lost' END AS Segment
  FROM sc)"""

oracle("rfm_segments", RFM_SCORED + "\nSELECT * FROM seg", "fact")

oracle("rfm_describe", f"""
WITH rfm AS ({RFM_BASE}),
s AS (
  SELECT 'recency' AS column_name, CAST(recency AS DOUBLE) AS x, CAST(recency AS DECIMAL(38,6)) AS d FROM rfm
  UNION ALL SELECT 'frequency', CAST(frequency AS DOUBLE), CAST(frequency AS DECIMAL(38,6)) FROM rfm
  UNION ALL SELECT 'monetary', monetary, CAST(monetary AS DECIMAL(38,6)) FROM rfm)
SELECT column_name, CAST(count(*) AS BIGINT) AS count,
  round_even(CAST(sum(d) AS DOUBLE) / count(*), 2) AS mean, round_even(stddev_samp(x), 2) AS std,
  round_even(min(x), 2) AS min, round_even(quantile_cont(x, 0.25), 2) AS p25,
  round_even(quantile_cont(x, 0.5), 2) AS p50, round_even(quantile_cont(x, 0.75), 2) AS p75,
  round_even(max(x), 2) AS max
FROM s GROUP BY column_name""", "fact")

oracle("rfm_edge_check", f"""
WITH rfm AS ({RFM_BASE})
SELECT 'recency' AS column_name,
       CAST(len(list_distinct(quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]))) AS BIGINT) AS distinct_edges FROM rfm
UNION ALL
SELECT 'monetary', CAST(len(list_distinct(quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]))) AS BIGINT) FROM rfm""",
       "fact")

oracle("segment_counts", RFM_SCORED + """
SELECT Segment, CAST(count(*) AS BIGINT) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM seg), 6) AS share_pct
FROM seg GROUP BY Segment ORDER BY count DESC, Segment""", "fact")

COHORT = """
WITH cm AS (SELECT DISTINCT customer_unique_id, date_trunc('month', order_purchase_timestamp) AS order_month FROM fact),
c1 AS (SELECT customer_unique_id, min(order_month) AS cohort_month FROM cm GROUP BY 1),
cp AS (SELECT cm.customer_unique_id, c1.cohort_month,
          12 * (year(cm.order_month) - year(c1.cohort_month)) + month(cm.order_month) - month(c1.cohort_month) AS period_number
       FROM cm JOIN c1 USING (customer_unique_id)),
cc AS (SELECT strftime(cohort_month, '%Y-%m') AS cohort, CAST(period_number AS BIGINT) AS period_number,
              CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS customers FROM cp GROUP BY 1, 2),
kp AS (SELECT period_number, dense_rank() OVER (ORDER BY period_number) AS period_rank
       FROM (SELECT DISTINCT period_number FROM cc)),
rt AS (SELECT cc.cohort, cc.period_number, CAST(kp.period_rank AS INT) AS period_rank, cc.customers, sz.customers AS cohort_size,
              round_even(cc.customers / sz.customers, 3) * 100.0 AS retention_pct
       FROM cc JOIN kp ON cc.period_number = kp.period_number
       LEFT JOIN (SELECT cohort, customers FROM cc WHERE period_number = 0) sz ON cc.cohort = sz.cohort
       WHERE kp.period_rank <= 6)"""

oracle("cohort_counts", COHORT + "\nSELECT * FROM cc", "fact")
oracle("cohort_retention", COHORT + "\nSELECT * FROM rt", "fact")
oracle("cohort_pivot", COHORT + """
SELECT cohort, max(retention_pct) FILTER (WHERE period_rank = 1) AS p0,
  max(retention_pct) FILTER (WHERE period_rank = 2) AS p1, max(retention_pct) FILTER (WHERE period_rank = 3) AS p2,
  max(retention_pct) FILTER (WHERE period_rank = 4) AS p3, max(retention_pct) FILTER (WHERE period_rank = 5) AS p4,
  max(retention_pct) FILTER (WHERE period_rank = 6) AS p5
FROM rt GROUP BY cohort""", "fact")


# ---- experiment -------------------------------------------------------------------
_RK = ("order_id", "order_item_id", "product_id", "payment_sequential")
_RKS = ", ".join(_RK)
EXP = f"""
WITH ids AS (SELECT DISTINCT customer_unique_id FROM fact),
ranked AS (SELECT customer_unique_id,
             row_number() OVER (ORDER BY {md5_sql('arm', 'customer_unique_id')}, customer_unique_id) AS rn,
             count(*) OVER () AS n FROM ids),
arms AS (SELECT customer_unique_id, CASE WHEN rn <= n // 2 THEN 'A' ELSE 'B' END AS arm FROM ranked),
base AS (SELECT a.arm, f.customer_unique_id, {", ".join("f." + c for c in _RK)},
                CAST(round(f.price * 100) AS BIGINT) AS cents
         FROM fact f JOIN arms a ON f.customer_unique_id = a.customer_unique_id),
tnum AS (SELECT customer_unique_id, row_number() OVER (ORDER BY customer_unique_id) - 1 AS tn,
                count(*) OVER () AS nt FROM arms WHERE arm = 'B'),
upl AS (SELECT arm, customer_unique_id, {_RKS},
               (cents * (104000000 + (8000000 * {md5_int_sql('uplift', *_RK)}) // 4294967296) + 50000000) // 100000000 AS cents,
               'base' AS origin
        FROM base WHERE arm = 'B'),
extra AS (SELECT 'B' AS arm, t.customer_unique_id, {", ".join("b." + c for c in _RK)}, b.cents, 'injected' AS origin
          FROM base b JOIN tnum t ON {md5_int_sql('target', *("b." + c for c in _RK))} % t.nt = t.tn
          WHERE b.arm = 'A' AND {md5_int_sql('extra', *("b." + c for c in _RK))} < 171798692),
rows AS (SELECT arm, customer_unique_id, {_RKS}, cents, 'base' AS origin FROM base WHERE arm = 'A'
         UNION ALL SELECT * FROM upl UNION ALL SELECT * FROM extra),
conv AS (SELECT a.arm, CAST(count(*) AS BIGINT) AS assigned, CAST(coalesce(max(b.converted), 0) AS BIGINT) AS converted,
                coalesce(max(b.converted), 0) / count(*) AS conversion_rate
         FROM arms a LEFT JOIN (SELECT arm, count(DISTINCT customer_unique_id) AS converted FROM rows GROUP BY arm) b
           ON a.arm = b.arm GROUP BY a.arm),
ov AS (SELECT arm, order_id, sum(cents) AS cents FROM rows GROUP BY arm, order_id),
cr AS (SELECT a.arm, a.customer_unique_id, CAST(coalesce(s.c, 0) AS BIGINT) AS cents
       FROM arms a LEFT JOIN (SELECT arm, customer_unique_id, sum(cents) AS c FROM rows GROUP BY 1, 2) s
         ON a.arm = s.arm AND a.customer_unique_id = s.customer_unique_id),
ovm AS (SELECT arm, count(*) AS n, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS mean,
               CAST(count(*) * sum(CAST(cents AS HUGEINT) * cents) - sum(CAST(cents AS HUGEINT)) * sum(CAST(cents AS HUGEINT)) AS DOUBLE)
                 / CAST(count(*) * (count(*) - 1) AS DOUBLE) / 10000.0 AS var FROM ov GROUP BY arm),
crm AS (SELECT arm, count(*) AS n, CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS mean,
               CAST(count(*) * sum(CAST(cents AS HUGEINT) * cents) - sum(CAST(cents AS HUGEINT)) * sum(CAST(cents AS HUGEINT)) AS DOUBLE)
                 / CAST(count(*) * (count(*) - 1) AS DOUBLE) / 10000.0 AS var FROM cr GROUP BY arm)"""


def _tail(x: str) -> str:
    """A&S 26.2.17 upper tail of |x| >= 0 (same polynomial as functions.stats)."""
    t = f"(1.0 / (1.0 + 0.2316419 * ({x})))"
    poly = (f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * "
            f"(-1.821255978 + {t} * 1.330274429)))))")
    return f"(0.3989422804014327 * exp(-(({x}) * ({x})) / 2.0) * {poly})"


def normal_sf_sql(z: str) -> str:
    return f"(CASE WHEN ({z}) >= 0 THEN {_tail(z)} ELSE 1.0 - {_tail('abs(' + z + ')')} END)"


oracle("arm_assignment", EXP + "\nSELECT customer_unique_id, arm FROM arms", "fact")
oracle("experiment_rows", EXP + f"\nSELECT arm, customer_unique_id, {_RKS}, cents / 100.0 AS price, origin FROM rows",
       "fact")
oracle("conversion", EXP + "\nSELECT * FROM conv", "fact")

oracle("chi_square", EXP + """,
w AS (SELECT max(CASE WHEN arm = 'A' THEN CAST(converted AS DOUBLE) END) AS ca,
             max(CASE WHEN arm = 'A' THEN CAST(assigned AS DOUBLE) END) AS na,
             max(CASE WHEN arm = 'B' THEN CAST(converted AS DOUBLE) END) AS cb,
             max(CASE WHEN arm = 'B' THEN CAST(assigned AS DOUBLE) END) AS nb FROM conv),
cells AS (
  SELECT o, row_t * col_t / (na + nb) AS e FROM (
    SELECT ca AS o, na AS row_t, ca + cb AS col_t, na, nb FROM w
    UNION ALL SELECT na - ca, na, na + nb - ca - cb, na, nb FROM w
    UNION ALL SELECT cb, nb, ca + cb, na, nb FROM w
    UNION ALL SELECT nb - cb, nb, na + nb - ca - cb, na, nb FROM w)),
adj AS (SELECT e, o + sign(e - o) * least(0.5, abs(e - o)) AS oa FROM cells),
s AS (SELECT sum(CASE WHEN e = 0 THEN NULL ELSE (oa - e) * (oa - e) / e END) AS chi, bool_or(e = 0) AS zero FROM adj)
SELECT CASE WHEN zero THEN NULL ELSE round(chi, 6) END AS chi2,
       CASE WHEN zero THEN 1.0 ELSE round(2.0 * """ + _tail("sqrt(chi)") + """, 6) END AS p_value,
       CAST(1 AS BIGINT) AS dof
FROM s""", "fact")

oracle("order_values", EXP + "\nSELECT arm, order_id, cents / 100.0 AS order_value FROM ov", "fact")

oracle("aov_lift", EXP + """
SELECT round(max(mean) FILTER (WHERE arm = 'A'), 6) AS mean_aov_A, round(max(mean) FILTER (WHERE arm = 'B'), 6) AS mean_aov_B,
       round((max(mean) FILTER (WHERE arm = 'B') - max(mean) FILTER (WHERE arm = 'A')) / max(mean) FILTER (WHERE arm = 'A') * 100.0, 6)
         AS aov_lift_pct
FROM ovm""", "fact")

oracle("welch_t", EXP + """,
w AS (SELECT max(mean) FILTER (WHERE arm = 'A') AS ma, max(mean) FILTER (WHERE arm = 'B') AS mb,
             max(var / n) FILTER (WHERE arm = 'A') AS sa, max(var / n) FILTER (WHERE arm = 'B') AS sb,
             max(n) FILTER (WHERE arm = 'A') AS na, max(n) FILTER (WHERE arm = 'B') AS nb FROM ovm)
SELECT round((ma - mb) / sqrt(sa + sb), 6) AS t_stat,
       round((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 6) AS df FROM w""", "fact")

oracle("customer_revenue", EXP + "\nSELECT arm, customer_unique_id, cents / 100.0 AS revenue FROM cr", "fact")

oracle("revenue_lift", EXP + """
SELECT round(max(mean) FILTER (WHERE arm = 'A'), 6) AS mean_rev_A, round(max(mean) FILTER (WHERE arm = 'B'), 6) AS mean_rev_B,
       round((max(mean) FILTER (WHERE arm = 'B') - max(mean) FILTER (WHERE arm = 'A')) / max(mean) FILTER (WHERE arm = 'A') * 100.0, 6)
         AS rev_lift_pct
FROM crm""", "fact")

oracle("mann_whitney", EXP + """,
rk AS (SELECT arm, cents, rank() OVER (ORDER BY cents) AS r0, count(*) OVER (PARTITION BY cents) AS t FROM cr),
s AS (SELECT sum(CASE WHEN arm = 'A' THEN r0 - 1 + (t + 1) / 2.0 END) AS r1,
             CAST(count(*) FILTER (WHERE arm = 'A') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE arm = 'B') AS DOUBLE) AS n2
      FROM rk),
tt AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT count(*) AS t FROM cr GROUP BY cents)),
z AS (SELECT r1 - n1 * (n1 + 1) / 2.0 AS u1,
             (n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0) - n1 * n2 / 2.0 - 0.5)
               / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z
      FROM s, tt)
SELECT round(u1, 6) AS u_stat, round(z, 6) AS z, round(least(greatest(""" + normal_sf_sql("z") + """, 0.0), 1.0), 6) AS p_value
FROM z""", "fact")

oracle("cohens_d", EXP + """,
w AS (SELECT max(mean) FILTER (WHERE arm = 'A') AS ma, max(mean) FILTER (WHERE arm = 'B') AS mb,
             max(var) FILTER (WHERE arm = 'A') AS va, max(var) FILTER (WHERE arm = 'B') AS vb FROM crm),
d AS (SELECT (mb - ma) / sqrt((va + vb) / 2.0) AS d FROM w)
SELECT round(d, 6) AS cohens_d,
       CASE WHEN abs(d) < 0.2 THEN 'Small' WHEN abs(d) < 0.5 THEN 'Medium' ELSE 'Large' END AS effect FROM d""", "fact")

oracle("required_sample_size", EXP + """,
w AS (SELECT max(conversion_rate) FILTER (WHERE arm = 'A') AS p1, max(conversion_rate) FILTER (WHERE arm = 'B') AS p2,
             sum(assigned) AS n FROM conv),
r AS (SELECT CAST(floor(2.0 * pow(1.959963984540054 * sqrt(2.0 * ((p1 + p2) / 2.0) * (1.0 - (p1 + p2) / 2.0))
                               + 0.8416212335729143 * sqrt(p1 * (1.0 - p1) + p2 * (1.0 - p2)), 2)
                         / greatest((p2 - p1) * (p2 - p1), 1e-10)) AS BIGINT) AS required_n,
             CAST(n // 2 AS BIGINT) AS actual_per_group FROM w)
SELECT required_n, actual_per_group, actual_per_group >= required_n AS powered FROM r""", "fact")

oracle("revenue_box_stats", EXP + """,
v AS (SELECT arm, cents / 100.0 AS revenue FROM cr),
k AS (SELECT * FROM v WHERE revenue <= (SELECT quantile_cont(revenue, 0.98) FROM v)),
q AS (SELECT arm, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.5) AS median,
             quantile_cont(revenue, 0.75) AS q3 FROM k GROUP BY arm),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.arm, CAST(count(*) AS BIGINT) AS n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, round(min(k.revenue) FILTER (WHERE k.revenue BETWEEN f.lo AND f.hi), 6) AS whisker_lo,
       round(max(k.revenue) FILTER (WHERE k.revenue BETWEEN f.lo AND f.hi), 6) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (k.revenue BETWEEN f.lo AND f.hi)) AS BIGINT) AS outliers
FROM k JOIN f ON k.arm = f.arm GROUP BY f.arm, f.q1, f.median, f.q3, f.iqr""", "fact")

oracle("order_value_histogram", EXP + """,
v0 AS (SELECT arm, cents / 100.0 AS value FROM ov),
e AS (SELECT arm, quantile_cont(value, 0.99) AS edge FROM v0 GROUP BY arm),
hv AS (SELECT v0.arm, least(v0.value, e.edge) AS v FROM v0 JOIN e ON v0.arm = e.arm),
hs AS (SELECT arm, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(*) AS n FROM hv GROUP BY arm),
hb AS (SELECT hv.arm, CAST(least(floor(CAST(40 AS DOUBLE) * (hv.v - hs.lo) / (hs.hi - hs.lo)) + 1, 40) AS BIGINT) AS bin,
              count(*) AS c FROM hv JOIN hs ON hv.arm = hs.arm GROUP BY 1, 2),
hg AS (SELECT CAST(range AS BIGINT) AS bin FROM range(1, 41))
SELECT hs.arm, hg.bin, round(hs.lo + (hs.hi - hs.lo) * (hg.bin - 1) / CAST(40 AS DOUBLE), 6) AS bin_lo,
       round(hs.lo + (hs.hi - hs.lo) * hg.bin / CAST(40 AS DOUBLE), 6) AS bin_hi,
       CAST(coalesce(hb.c, 0) AS BIGINT) AS count,
       round(coalesce(hb.c, 0) / (hs.n * ((hs.hi - hs.lo) / CAST(40 AS DOUBLE))), 9) AS density
FROM hs CROSS JOIN hg LEFT JOIN hb ON hs.arm = hb.arm AND hg.bin = hb.bin""", "fact")


# ---- churn ------------------------------------------------------------------------
LABELS = f"""
SELECT customer_unique_id, strftime(max(order_purchase_timestamp), '%Y-%m-%d %H:%M:%S') AS last_purchase,
       CAST(floor(epoch({SNAP} - max(order_purchase_timestamp)) / 86400) AS BIGINT) AS days_since,
       CAST(floor(epoch({SNAP} - max(order_purchase_timestamp)) / 86400) > 180 AS INT) AS churn
FROM fact GROUP BY customer_unique_id"""

oracle("churn_labels", LABELS, "fact")
oracle("churn_rate", f"""
WITH l AS ({LABELS})
SELECT churn, CAST(count(*) AS BIGINT) AS customers, (SELECT round(avg(churn) * 100.0, 6) FROM l) AS churn_rate_pct
FROM l GROUP BY churn""", "fact")

FEATS = f"""
SELECT customer_unique_id,
  CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
  round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE), 6) AS total_revenue,
  round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price), 6) AS avg_order_value,
  round(max(price), 6) AS max_order_value, round(min(price), 6) AS min_order_value,
  CAST(count(order_item_id) AS BIGINT) AS total_items,
  round(CAST(sum(CAST(order_item_id AS DECIMAL(38,6))) AS DOUBLE) / count(order_item_id), 6) AS avg_items_order,
  round(CAST(sum(CAST(freight_value AS DECIMAL(18,2))) AS DOUBLE), 6) AS total_freight,
  round(CAST(sum(CAST(freight_value AS DECIMAL(18,2))) AS DOUBLE) / count(freight_value), 6) AS avg_freight,
  CAST(count(DISTINCT product_category_name_english) AS BIGINT) AS unique_categories,
  round(CAST(sum(CAST(delivery_days AS DECIMAL(38,6))) AS DOUBLE) / count(delivery_days), 6) AS avg_delivery_days,
  round(CAST(sum(CAST(payment_installments AS DECIMAL(38,6))) AS DOUBLE) / count(payment_installments), 6) AS payment_installments,
  CAST(floor(epoch({SNAP} - max(order_purchase_timestamp)) / 86400) AS BIGINT) AS recency,
  CAST(floor(epoch(max(order_purchase_timestamp) - min(order_purchase_timestamp)) / 86400) AS BIGINT) AS days_active,
  round(count(DISTINCT order_id) / (floor(epoch(max(order_purchase_timestamp) - min(order_purchase_timestamp)) / 86400) + 1), 6)
    AS purchase_frequency,
  round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT order_id), 6) AS revenue_per_order
FROM fact GROUP BY customer_unique_id"""

oracle("customer_features", FEATS, "fact")

_FCOLS = ["total_orders", "total_revenue", "avg_order_value", "max_order_value", "min_order_value",
          "total_items", "avg_items_order", "total_freight", "avg_freight", "unique_categories",
          "avg_delivery_days", "payment_installments", "recency", "days_active", "purchase_frequency",
          "revenue_per_order"]
MATRIX = f"""
WITH feats AS ({FEATS}), labels AS ({LABELS}),
m AS (SELECT feats.*, labels.churn FROM feats JOIN labels USING (customer_unique_id)),
med AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in _FCOLS)} FROM m),
mx AS (SELECT customer_unique_id, {", ".join(f"round(coalesce(CAST({c} AS DOUBLE), med_{c}), 6) AS {c}" for c in _FCOLS)}, churn
       FROM m, med)"""

oracle("churn_matrix", MATRIX + "\nSELECT * FROM mx", "fact")
oracle("recency_orders_by_class", MATRIX + "\nSELECT customer_unique_id, recency, total_orders, churn FROM mx", "fact")

oracle("stratified_split", MATRIX + f""",
r AS (SELECT customer_unique_id, churn,
        row_number() OVER (PARTITION BY churn ORDER BY {md5_sql('split', 'customer_unique_id')}, customer_unique_id) AS rn,
        count(*) OVER (PARTITION BY churn) AS n FROM mx)
SELECT customer_unique_id, churn, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM r""", "fact")

FIXED = MATRIX + f""",
pred AS (SELECT customer_unique_id, churn AS label,
           round({md5_unit_sql('score', 'customer_unique_id')} * 0.6 + least(recency, 400) / 400.0 * 0.4, 3) AS score
         FROM mx),
pr AS (SELECT *, CAST(score >= 0.5 AS INT) AS prediction FROM pred)"""

oracle("auc_fixed_score", FIXED + """,
rk AS (SELECT label, rank() OVER (ORDER BY score) AS r0, count(*) OVER (PARTITION BY score) AS t FROM pr)
SELECT round((sum(CASE WHEN label = 1 THEN r0 - 1 + (t + 1) / 2.0 END)
              - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
             / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)), 6) AS auc
FROM rk""", "fact")

oracle("roc_fixed_score", FIXED + """,
d AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM pr GROUP BY score),
tot AS (SELECT sum(p) AS tp, sum(n) AS tn FROM d)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT d1.score AS threshold,
       round((SELECT sum(n) FROM d d2 WHERE d2.score >= d1.score) / tot.tn, 6) AS fpr,
       round((SELECT sum(p) FROM d d2 WHERE d2.score >= d1.score) / tot.tp, 6) AS tpr
FROM d d1, tot""", "fact")

oracle("confusion_fixed_score", FIXED + """
SELECT g.actual, g.predicted, CAST(count(pr.label) AS BIGINT) AS count
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted)) g
LEFT JOIN pr ON pr.label = g.actual AND pr.prediction = g.predicted
GROUP BY g.actual, g.predicted""", "fact")

oracle("class_report_fixed_score", FIXED + """,
c AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS c00,
             CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS c01,
             CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS c10,
             CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS c11 FROM pr),
per AS (
  SELECT 'Active' AS class, coalesce(c00 / nullif(c00 + c10, 0), 0.0) AS precision,
         coalesce(c00 / nullif(c00 + c01, 0), 0.0) AS recall, c00 + c01 AS support FROM c
  UNION ALL
  SELECT 'Churned', coalesce(c11 / nullif(c11 + c01, 0), 0.0), coalesce(c11 / nullif(c11 + c10, 0), 0.0), c10 + c11 FROM c),
per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM per),
allr AS (
  SELECT class, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, (c00 + c11) / (c00 + c01 + c10 + c11), c00 + c01 + c10 + c11 FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM per2)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allr""", "fact")

oracle("probability_histogram_fixed_score", FIXED + """,
hb AS (SELECT label, CAST(least(floor(CAST(40 AS DOUBLE) * (score - 0.0) / (1.0 - 0.0)) + 1, 40) AS BIGINT) AS bin,
              count(*) AS c FROM pr WHERE score BETWEEN 0.0 AND 1.0 GROUP BY 1, 2),
hl AS (SELECT DISTINCT label FROM pr WHERE score BETWEEN 0.0 AND 1.0),
hg AS (SELECT CAST(range AS BIGINT) AS bin FROM range(1, 41))
SELECT hl.label, hg.bin, round(0.0 + (1.0 - 0.0) * (hg.bin - 1) / CAST(40 AS DOUBLE), 6) AS bin_lo,
       round(0.0 + (1.0 - 0.0) * hg.bin / CAST(40 AS DOUBLE), 6) AS bin_hi, CAST(coalesce(hb.c, 0) AS BIGINT) AS count
FROM hl CROSS JOIN hg LEFT JOIN hb ON hl.label = hb.label AND hg.bin = hb.bin""", "fact")


# ---- review text -------------------------------------------------------------------
from ..functions.text import (  # noqa: E402
    BOOSTERS_DOWN, BOOSTERS_UP, DOMAIN_STOPWORDS, ENGLISH_STOPWORDS, NEGATORS,
)


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_BOOST_VALUES = ", ".join([f"('{w}', 0.293)" for w in BOOSTERS_UP] + [f"('{w}', -0.293)" for w in BOOSTERS_DOWN])
_NEG_VALUES = ", ".join(f"('{w}')" for w in NEGATORS)
_STOP = _sql_list(ENGLISH_STOPWORDS + DOMAIN_STOPWORDS)

TEXT = r"""
WITH c AS (
  SELECT order_id, review_score, review_creation_date,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(review_comment_message, '')),
      'http\S+|www\S+', '', 'g'), '[^a-zA-Z\s]', '', 'g'), '\s+', ' ', 'g')) AS clean_comment
  FROM fx_reviews),
cr AS (SELECT * FROM c WHERE length(clean_comment) > 5),
tk AS (SELECT order_id, list_filter(string_split(clean_comment, ' '), lambda x: length(x) > 1) AS toks FROM cr),
u AS (SELECT order_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM tk),
bst AS (SELECT * FROM (VALUES __BOOST__) AS t(w, b)),
neg AS (SELECT * FROM (VALUES __NEG__) AS t(w)),
ul AS (SELECT order_id, pos, tok,
         lag(tok, 1) OVER (PARTITION BY order_id ORDER BY pos) AS w1,
         lag(tok, 2) OVER (PARTITION BY order_id ORDER BY pos) AS w2,
         lag(tok, 3) OVER (PARTITION BY order_id ORDER BY pos) AS w3 FROM u),
uj AS (SELECT ul.*, lx.valence AS lv, b0.b AS tb,
         l1.term IS NOT NULL AS lex1, coalesce(b1.b, 0.0) AS b1, n1.w IS NOT NULL AS neg1,
         l2.term IS NOT NULL AS lex2, coalesce(b2.b, 0.0) AS b2, n2.w IS NOT NULL AS neg2,
         l3.term IS NOT NULL AS lex3, coalesce(b3.b, 0.0) AS b3, n3.w IS NOT NULL AS neg3
       FROM ul
       LEFT JOIN fx_lexicon lx ON ul.tok = lx.term LEFT JOIN bst b0 ON ul.tok = b0.w
       LEFT JOIN fx_lexicon l1 ON ul.w1 = l1.term LEFT JOIN bst b1 ON ul.w1 = b1.w LEFT JOIN neg n1 ON ul.w1 = n1.w
       LEFT JOIN fx_lexicon l2 ON ul.w2 = l2.term LEFT JOIN bst b2 ON ul.w2 = b2.w LEFT JOIN neg n2 ON ul.w2 = n2.w
       LEFT JOIN fx_lexicon l3 ON ul.w3 = l3.term LEFT JOIN bst b3 ON ul.w3 = b3.w LEFT JOIN neg n3 ON ul.w3 = n3.w),
s0 AS (SELECT *, CASE WHEN tb IS NOT NULL THEN 0.0 ELSE coalesce(lv, 0.0) END AS v0 FROM uj),
s1 AS (SELECT *, CASE WHEN w1 IS NOT NULL AND NOT lex1 THEN
         (v0 + CASE WHEN v0 < 0 THEN -(b1 * 1.0) ELSE b1 * 1.0 END) * CASE WHEN neg1 THEN -0.74 ELSE 1.0 END
         ELSE v0 END AS v1 FROM s0),
s2 AS (SELECT *, CASE WHEN w2 IS NOT NULL AND NOT lex2 THEN
         (v1 + CASE WHEN v1 < 0 THEN -(b2 * 0.95) ELSE b2 * 0.95 END) * CASE WHEN neg2 THEN -0.74 ELSE 1.0 END
         ELSE v1 END AS v2 FROM s1),
s3 AS (SELECT *, CASE WHEN w3 IS NOT NULL AND NOT lex3 THEN
         (v2 + CASE WHEN v2 < 0 THEN -(b3 * 0.9) ELSE b3 * 0.9 END) * CASE WHEN neg3 THEN -0.74 ELSE 1.0 END
         ELSE v2 END AS v3 FROM s2),
bp AS (SELECT order_id, min(pos) FILTER (WHERE tok = 'but') AS bpos FROM u GROUP BY order_id),
tv AS (SELECT s3.order_id, s3.pos,
         CASE WHEN lv IS NOT NULL AND tb IS NULL THEN v3 ELSE 0.0 END
         * CASE WHEN bp.bpos IS NULL THEN 1.0 WHEN s3.pos < bp.bpos THEN 0.5 WHEN s3.pos > bp.bpos THEN 1.5 ELSE 1.0 END AS v
       FROM s3 JOIN bp ON s3.order_id = bp.order_id),
tot AS (SELECT order_id, sum(v ORDER BY pos) AS x FROM tv GROUP BY order_id),
scored AS (
  SELECT cr.order_id, cr.review_score, cr.review_creation_date, cr.clean_comment,
    CASE WHEN tot.x IS NULL OR round(tot.x / sqrt(tot.x * tot.x + 15.0), 4) = 0 THEN 0.0
         ELSE round(least(greatest(tot.x / sqrt(tot.x * tot.x + 15.0), -1.0), 1.0), 4) END AS sentiment_score,
    array_to_string(list_filter(string_split(cr.clean_comment, ' '),
        lambda w: length(w) >= 3 AND NOT list_contains(__STOP__, w)), ' ') AS filtered_text
  FROM cr LEFT JOIN tot ON cr.order_id = tot.order_id),
sc AS (SELECT *, CASE WHEN sentiment_score >= 0.05 THEN 'Positive' WHEN sentiment_score <= -0.05 THEN 'Negative'
                      ELSE 'Neutral' END AS sentiment FROM scored)"""
# the same rules with boosters, negators and a contrast word that occur in the documents
RULES = TEXT.replace("__BOOST__", "('by', 0.293), ('with', 0.293), ('at', -0.293)").replace("__NEG__", "('is'), ('are')").replace(
    "tok = 'but'", "tok = 'as'").replace("__STOP__", _STOP)
TEXT = TEXT.replace("__BOOST__", _BOOST_VALUES).replace("__NEG__", _NEG_VALUES).replace("__STOP__", _STOP)

oracle("clean_reviews", TEXT + "\nSELECT order_id, review_score, clean_comment FROM cr", "fx_reviews", "fx_lexicon")
oracle("review_sentiment", TEXT + "\nSELECT order_id, review_score, sentiment_score, sentiment FROM sc",
       "fx_reviews", "fx_lexicon")
oracle("filtered_tokens", TEXT + "\nSELECT order_id, filtered_text FROM sc", "fx_reviews", "fx_lexicon")
oracle("sentiment_counts", TEXT + """
SELECT sentiment, CAST(count(*) AS BIGINT) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM sc), 6) AS share_pct
FROM sc GROUP BY sentiment ORDER BY count DESC, sentiment""", "fx_reviews", "fx_lexicon")
oracle("sentiment_by_score", TEXT + """
SELECT review_score, round_even(CAST(sum(CAST(sentiment_score AS DECIMAL(12,4))) AS DOUBLE) / count(*), 3) AS avg_sentiment
FROM sc GROUP BY review_score ORDER BY review_score""", "fx_reviews", "fx_lexicon")
oracle("score_counts", """
SELECT review_score, CAST(count(*) AS BIGINT) AS count FROM fx_reviews WHERE review_score IS NOT NULL
GROUP BY review_score ORDER BY review_score""", "fx_reviews")
oracle("sentiment_by_month", TEXT + """
SELECT strftime(review_creation_date, '%Y-%m') AS month,
       round(CAST(sum(CAST(sentiment_score AS DECIMAL(12,4))) AS DOUBLE) / count(*), 6) AS avg_sentiment
FROM sc WHERE review_creation_date IS NOT NULL GROUP BY 1""", "fx_reviews", "fx_lexicon")
oracle("term_frequencies", TEXT + """,
tw AS (SELECT sentiment, unnest(list_filter(string_split(filtered_text, ' '), lambda x: length(x) > 0)) AS term FROM sc),
g AS (SELECT sentiment AS "group", term, count(*) AS count FROM tw WHERE sentiment IN ('Positive', 'Negative') GROUP BY 1, 2
      UNION ALL SELECT 'All', term, count(*) FROM tw GROUP BY 2),
r AS (SELECT "group", term, CAST(count AS BIGINT) AS count,
             row_number() OVER (PARTITION BY "group" ORDER BY count DESC, term) AS rank FROM g)
SELECT "group", term, count, CAST(rank AS INT) AS rank FROM r WHERE rank <= 80""", "fx_reviews", "fx_lexicon")
oracle("bag_of_words_vocabulary", TEXT + """,
tw AS (SELECT order_id, unnest(list_filter(string_split(filtered_text, ' '), lambda x: length(x) > 0)) AS term FROM sc),
st AS (SELECT term, CAST(count(DISTINCT order_id) AS BIGINT) AS doc_freq, CAST(count(*) AS BIGINT) AS term_count
       FROM tw GROUP BY term),
k AS (SELECT * FROM st WHERE doc_freq >= 5 AND doc_freq <= 0.8 * (SELECT count(*) FROM sc)
      ORDER BY term_count DESC, term LIMIT 1000)
SELECT term, doc_freq, term_count, CAST(row_number() OVER (ORDER BY term_count DESC, term) - 1 AS BIGINT) AS term_index
FROM k""", "fx_reviews", "fx_lexicon")

oracle("english_review_sentiment",
       TEXT.replace("  FROM fx_reviews),\ncr AS", "  FROM fx_reviews WHERE lang = 'en'),\ncr AS")
       + "\nSELECT order_id, review_score, sentiment_score, sentiment FROM sc", "fx_reviews", "fx_lexicon")


# ---- the experiment over all customers, and null keys ---------------------------------
for _name in ("conversion", "chi_square", "required_sample_size"):
    oracle(f"{_name}_all_customers", BODY[_name].replace("SELECT DISTINCT customer_unique_id FROM fact",
                                                         "SELECT DISTINCT customer_unique_id FROM fx_customers"), "fact", "fx_customers")
cte("fact_null_keys", """
SELECT * REPLACE (CASE WHEN order_id % 7 <> 0 THEN order_purchase_timestamp END AS order_purchase_timestamp,
                  CASE WHEN order_id % 11 <> 0 THEN customer_unique_id END AS customer_unique_id) FROM fact""", ["fact"])
cte("fact_dated", "SELECT * FROM fact_null_keys WHERE order_purchase_timestamp IS NOT NULL", ["fact_null_keys"])
cte("fact_dated_customers", "SELECT * FROM fact_dated WHERE customer_unique_id IS NOT NULL", ["fact_dated"])
for _name in ("monthly_revenue", "monthly_orders", "rows_by_hour", "cumulative_revenue"):
    oracle(f"{_name}_null_keys", BODY[_name].replace("FROM fact", "FROM fact_dated"), "fact_dated")
oracle("cohort_counts_null_keys", BODY["cohort_counts"].replace("FROM fact", "FROM fact_dated_customers"), "fact_dated_customers")
oracle("churn_labels_null_keys", f"""
WITH l AS (SELECT customer_unique_id, max(order_purchase_timestamp) AS last FROM fact_null_keys
           WHERE customer_unique_id IS NOT NULL GROUP BY 1),
d AS (SELECT *, CAST(floor(epoch({SNAP} - last) / 86400) AS BIGINT) AS days_since FROM l)
SELECT customer_unique_id, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_purchase, days_since,
       CAST(coalesce(days_since > 180, false) AS INT) AS churn FROM d""", "fact_null_keys")


# ---- the test summary: each part is the body of its own query ------------------------
def _part(name: str) -> str:
    rest = BODY[name][len(EXP):].strip()
    return f"(WITH {rest[1:]})" if rest.startswith(",") else f"({rest})"


_T_P = """(WITH RECURSIVE
w AS (SELECT max(mean) FILTER (WHERE arm = 'A') AS ma, max(mean) FILTER (WHERE arm = 'B') AS mb,
             max(var / n) FILTER (WHERE arm = 'A') AS sa, max(var / n) FILTER (WHERE arm = 'B') AS sb,
             max(n) FILTER (WHERE arm = 'A') AS na, max(n) FILTER (WHERE arm = 'B') AS nb FROM ovm),
s AS (SELECT (ma - mb) / sqrt(sa + sb) AS t, (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) AS df FROM w),
x AS (SELECT df, df / (df + t * t) AS x FROM s),
f AS (SELECT df, x, x >= (df / 2 + 1) / (df / 2 + 2.5) AS flip FROM x),
q AS (SELECT flip, CASE WHEN flip THEN 0.5::DOUBLE ELSE df / 2 END AS a, CASE WHEN flip THEN df / 2 ELSE 0.5::DOUBLE END AS b,
             CASE WHEN flip THEN 1 - x ELSE x END AS y FROM f),
l AS (SELECT 0 AS m, 1::DOUBLE AS c, 1 / (1 - (a + b) * y / (a + 1)) AS d, 1 / (1 - (a + b) * y / (a + 1)) AS h FROM q
  UNION ALL
  SELECT m, 1 + e2 / c1, 1 / (1 + e2 * d1), h * c1 * d1 * (1 + e2 / c1) / (1 + e2 * d1) FROM (
    SELECT m, h, 1 + e1 / c AS c1, 1 / (1 + e1 * d) AS d1, e2 FROM (
      SELECT l.m + 1 AS m, c, d, h, (l.m + 1) * (b - l.m - 1) * y / ((a + 2 * l.m + 1) * (a + 2 * l.m + 2)) AS e1,
        -(a + l.m + 1) * (a + b + l.m + 1) * y / ((a + 2 * l.m + 2) * (a + 2 * l.m + 3)) AS e2
      FROM l, q WHERE l.m < 1000)))
SELECT round(CASE WHEN flip THEN 1 - p ELSE p END, 6) AS p FROM (
  SELECT flip, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(y) + b * ln(1 - y)) * h / a AS p FROM q, l WHERE m = 1000))"""

_AB = EXP + f""",
a_chi AS {_part('chi_square')}, a_aov AS {_part('aov_lift')}, a_p AS {_T_P}, a_rev AS {_part('revenue_lift')},
a_mw AS {_part('mann_whitney')}, a_d AS {_part('cohens_d')}, a_n AS {_part('required_sample_size')},
a_c AS (SELECT max(assigned) FILTER (WHERE arm = 'A') AS na, max(assigned) FILTER (WHERE arm = 'B') AS nb,
               max(conversion_rate) FILTER (WHERE arm = 'A') AS pa, max(conversion_rate) FILTER (WHERE arm = 'B') AS pb FROM conv),
ab AS (SELECT na AS n_control, nb AS n_treatment, round((pb - pa) * 100.0, 6) AS conversion_lift_pts,
              round((pb - pa) / pa * 100.0, 6) AS conversion_lift_pct, a_chi.p_value AS p_conv, aov_lift_pct, a_p.p AS p_aov,
              rev_lift_pct, a_mw.p_value AS p_rev, cohens_d, effect, required_n, powered,
              a_chi.p_value < 0.05 AND a_p.p < 0.05 AS launch
       FROM a_c, a_chi, a_aov, a_p, a_rev, a_mw, a_d, a_n)"""
oracle("ab_summary", _AB + "\nSELECT * FROM ab", "fact")
oracle("lift_table", _AB + """
SELECT metric, lift_pct, p_value, p_value < 0.05 AS significant FROM (
  SELECT 'conversion' AS metric, conversion_lift_pct AS lift_pct, p_conv AS p_value FROM ab
  UNION ALL SELECT 'order_value', aov_lift_pct, p_aov FROM ab
  UNION ALL SELECT 'revenue', rev_lift_pct, p_rev FROM ab)""", "fact")
for _name in ("ab_summary", "lift_table"):
    oracle(f"{_name}_all_customers", BODY[_name].replace("SELECT DISTINCT customer_unique_id FROM fact",
                                                         "SELECT DISTINCT customer_unique_id FROM fx_customers"), "fact", "fx_customers")


# ---- facts of the model and topic queries ---------------------------------------------
oracle("fold_sizes", MATRIX + f""",
r AS (SELECT churn, (row_number() OVER (PARTITION BY churn ORDER BY {md5_sql('fold', 'customer_unique_id')}, customer_unique_id) - 1) % 5
        AS fold FROM mx)
SELECT churn, CAST(fold AS INT) AS fold, CAST(count(*) AS BIGINT) AS customers FROM r GROUP BY 1, 2""", "fact")
oracle("model_support", MATRIX + """,
c AS (SELECT churn, CAST(ceil(0.2 * count(*)) AS BIGINT) AS support FROM mx GROUP BY churn)
SELECT m.model, a.actual, coalesce(c.support, 0) AS support
FROM (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) m(model),
     (VALUES (0), (1)) a(actual) LEFT JOIN c ON c.churn = a.actual""", "fact")
oracle("scored_customer_total", MATRIX + "\nSELECT churn, CAST(count(*) AS BIGINT) AS scored FROM mx GROUP BY churn", "fact")
oracle("topic_count_total", TEXT + "\nSELECT CAST(count(*) AS BIGINT) AS reviews FROM sc", "fx_reviews", "fx_lexicon")


# ---- file edges and sentiment rules ----------------------------------------------------
oracle("csv_orders_by_month", """
SELECT strftime(CASE WHEN order_id % 50 <> 0 THEN order_purchase_timestamp END, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS orders,
  CAST(count(order_approved_at) AS BIGINT) AS approved, CAST(count(order_delivered_customer_date) AS BIGINT) AS delivered
FROM fx_orders GROUP BY 1""", "fx_orders")
oracle("csv_review_scores", """
SELECT review_score, CAST(count(*) AS BIGINT) AS reviews, CAST(count(review_comment_message) AS BIGINT) AS comments,
  CAST(sum(length(review_comment_message)) AS BIGINT) AS chars,
  CAST(sum(length(review_comment_message) - length(replace(review_comment_message, chr(10), ''))) AS BIGINT) AS newlines
FROM fx_reviews GROUP BY review_score""", "fx_reviews")
oracle("review_sentiment_rules", RULES + "\nSELECT order_id, review_score, sentiment_score FROM sc", "fx_reviews", "fx_lexicon")
# the same rules over a word table of the comments' own tokens
oracle("review_sentiment_large_lexicon", RULES.replace("bst AS (", """big_lexicon AS (SELECT DISTINCT tok AS term,
  ((ascii(tok) + length(tok)) * 7 % 41 - 20) / 10.0 AS valence FROM u WHERE (ascii(tok) + length(tok)) % 3 <> 0),
bst AS (""").replace("fx_lexicon", "big_lexicon") + "\nSELECT order_id, review_score, sentiment_score FROM sc", "fx_reviews")

# ---- evaluation per group, bends of the curve, exact U, round bins ----------------------
FOLDED = FIXED + f""",
fo AS (SELECT pr.*, CAST((row_number() OVER (PARTITION BY label ORDER BY {md5_sql('fold', 'customer_unique_id')}, customer_unique_id) - 1) % 5 AS INT)
  AS fold FROM pr)"""
oracle("auc_by_fold_fixed_score", FOLDED + """,
rk AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY score) AS r0, count(*) OVER (PARTITION BY fold, score) AS t FROM fo)
SELECT fold, round((sum(CASE WHEN label = 1 THEN r0 - 1 + (t + 1) / 2.0 END)
              - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
             / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)), 6) AS auc
FROM rk GROUP BY fold""", "fact")


def _bends(source: str, by: str) -> str:
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    over = f"({part} ORDER BY score DESC)"
    return f""",
d AS (SELECT {keys}score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM {source} GROUP BY {keys}score),
c AS (SELECT {keys}score, sum(n) OVER {over} AS fp, sum(p) OVER {over} AS tp, sum(n) OVER ({part}) AS tn, sum(p) OVER ({part}) AS tt FROM d),
b AS (SELECT *, lag(fp) OVER {over} + lead(fp) OVER {over} - 2 * fp AS f2, lag(tp) OVER {over} + lead(tp) OVER {over} - 2 * tp AS t2 FROM c)
SELECT {keys}CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM d {f'GROUP BY {by}' if by else 'LIMIT 1'}
UNION ALL
SELECT {keys}score AS threshold, round(fp / tn, 6) AS fpr, round(tp / tt, 6) AS tpr FROM b WHERE f2 IS NULL OR f2 <> 0 OR t2 <> 0"""


oracle("roc_bends_fixed_score", FIXED + _bends("pr", "").replace("FROM d LIMIT 1", "FROM (SELECT 1 FROM d LIMIT 1)"), "fact")
oracle("roc_bends_by_fold_fixed_score", FOLDED + _bends("fo", "fold"), "fact")
oracle("mann_whitney_top_customers", EXP + """,
top AS (SELECT arm, cents FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY cents DESC, customer_unique_id) AS k FROM cr) WHERE k <= 8),
r AS (SELECT arm, row_number() OVER (ORDER BY cents) AS i FROM top),
s AS (SELECT count(*) FILTER (WHERE arm = 'A') AS n1, count(*) FILTER (WHERE arm = 'B') AS n2, sum(i) FILTER (WHERE arm = 'A') AS r1 FROM r),
q AS (SELECT list_sum(list_transform(range(1, n1 + n2 + 1), lambda i: ((m >> CAST(i - 1 AS INT)) & 1) * i)) AS total
  FROM (SELECT range AS m FROM range(65536)), s WHERE m < pow(2, n1 + n2) AND bit_count(m) = n1)
SELECT round(CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE), 6) AS u_stat,
  round((n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1)), 6) AS z,
  round((SELECT count(*) FROM q WHERE total <= r1) / (SELECT CAST(count(*) AS DOUBLE) FROM q), 6) AS p_value FROM s""", "fact")


def round_histogram_sql(col: str, bins: int, where: str = "TRUE") -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS v FROM fact WHERE {col} IS NOT NULL AND ({where})),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
w AS (SELECT lo, hi, min(x * pow(10.0, k)) AS w FROM e, (VALUES (1.0::DOUBLE), (2.0), (5.0)) AS m(x), (SELECT unnest(range(-6, 12)) AS k)
  WHERE floor(hi / (x * pow(10.0, k))) - floor(lo / (x * pow(10.0, k))) + 1 <= {bins} GROUP BY lo, hi),
g AS (SELECT w, unnest(range(CAST(floor(lo / w) AS BIGINT), CAST(floor(hi / w) AS BIGINT) + 1)) AS i FROM w),
c AS (SELECT CAST(floor(v / w) AS BIGINT) AS i, count(*) AS n FROM v, w GROUP BY 1)
SELECT round(g.i * g.w, 6) AS bin_lo, round((g.i + 1) * g.w, 6) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM g LEFT JOIN c ON c.i = g.i"""


oracle("price_round_histogram", round_histogram_sql("price", 60), "fact")
oracle("delivery_round_histogram", round_histogram_sql("delivery_days", 40, "delivery_days BETWEEN 0 AND 60"), "fact")

# ---- dashboard panels, one by one --------------------------------------------------------
oracle("dashboard_panels", " UNION ALL ".join(
    [f"SELECT 'kpis' AS panel, '{c}' AS label, CAST({c} AS DOUBLE) AS value FROM ({BODY['kpis']})"
     for c in ("total_revenue", "total_orders", "total_customers", "avg_order_value")]
    + [f"SELECT '{n}.{v}' AS panel, CAST({k} AS VARCHAR) AS label, CAST({v} AS DOUBLE) AS value FROM ({BODY[n]})" for n, k, v in (
        ("monthly_revenue", "month", "revenue"), ("monthly_orders", "month", "orders"), ("top_categories", "category", "revenue"),
        ("rows_by_weekday", "day", "orders"), ("rows_by_weekday", "day", "distinct_orders"), ("revenue_by_payment", "payment", "revenue"),
        ("cumulative_revenue", "month", "cumulative"), ("delivery_histogram", "bin", "count"), ("rows_by_hour", "hour", "order_count"),
        ("price_histogram", "bin", "count"))]), "fact")

# ---- parallel CSV, bucketed stage, merged states -------------------------------------------
oracle("csv_review_scores_parallel", BODY["csv_review_scores"], "fx_reviews")
oracle("customer_profile", f"""
WITH a AS ({RFM_BASE}), l AS ({LABELS})
SELECT a.*, l.last_purchase, l.churn FROM a JOIN l USING (customer_unique_id)""", "fact")
oracle("monthly_orders_merged", BODY["monthly_orders"], "fact")
oracle("monthly_customers_merged", """
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS customers
FROM fact GROUP BY 1""", "fact")

HOT = with_ctes("SELECT * FROM wide", "wide").replace("o_custkey AS customer_id", """CASE WHEN o_orderkey % 2 = 0 THEN 1
  WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS customer_id""")
oracle("revenue_by_state_hot_customer", f"""
SELECT customer_state, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS customers,
  CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM ({HOT}) GROUP BY customer_state""")

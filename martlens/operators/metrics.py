"""Plain aggregates, top-k and running totals over the clean fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WEEKDAYS, money, month_label, ratio

TS = "order_purchase_timestamp"


def monthly_revenue(fact: DataFrame) -> DataFrame:
    """A1: price sum per purchase month (yyyy-MM); rows without a date are dropped."""
    return (fact.where(F.col(TS).isNotNull()).groupBy(month_label(TS).alias("month"))
            .agg(F.sum(money("price")).cast("double").alias("revenue")))


def monthly_orders(fact: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A2: distinct orders per purchase month (exact; ``approx=True`` uses the
    HyperLogLog++ sketch with relative error ``rsd``, a fixed-size state)."""
    n = F.approx_count_distinct("order_id", rsd) if approx else F.countDistinct("order_id")
    return fact.where(F.col(TS).isNotNull()).groupBy(month_label(TS).alias("month")).agg(n.cast("bigint").alias("orders"))


def rows_by_weekday(fact: DataFrame) -> DataFrame:
    """A3 + J7: fact rows (and distinct orders) per weekday, aligned to Monday..Sunday.

    Missing weekdays stay null, as a reindex would leave them.
    """
    days = fact.sparkSession.createDataFrame([(i + 1, d) for i, d in enumerate(WEEKDAYS)], "day_index int, day string")
    counts = fact.groupBy(F.date_format(TS, "EEEE").alias("day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("orders"),
        F.countDistinct("order_id").cast("bigint").alias("distinct_orders"))
    return days.join(counts, "day", "left").select("day_index", "day", "orders", "distinct_orders")


def rows_by_hour(fact: DataFrame) -> DataFrame:
    """A4: fact rows per purchase hour, ascending."""
    return (fact.where(F.col(TS).isNotNull()).groupBy(F.hour(TS).cast("bigint").alias("hour"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("order_count")).orderBy("hour"))


def revenue_by_payment(fact: DataFrame) -> DataFrame:
    """A5: price sum per payment type; the null type is dropped (pandas grouping)."""
    return (fact.where(F.col("payment_type").isNotNull()).groupBy(F.col("payment_type").alias("payment"))
            .agg(F.sum(money("price")).cast("double").alias("revenue")))


def payment_breakdown(fact: DataFrame) -> DataFrame:
    """Rows and payment value sum per payment type, null type kept, by count desc (SQL grouping)."""
    return (fact.groupBy("payment_type")
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                 F.round(F.sum(money("payment_value")), 2).cast("double").alias("total_value"))
            .orderBy(F.desc("count"), "payment_type"))


def kpis(fact: DataFrame) -> DataFrame:
    """Revenue, distinct orders, distinct customers, revenue per order (one row).

    Two distinct counts in one aggregate expand the rows; grouping to the
    (order, customer) grain first keeps the expansion on far fewer rows.
    """
    per_order = fact.groupBy("order_id", "customer_unique_id").agg(F.sum(money("price")).alias("_rev"))
    k = per_order.agg(
        F.sum("_rev").cast("double").alias("total_revenue"),
        F.countDistinct("order_id").cast("bigint").alias("total_orders"),
        F.countDistinct("customer_unique_id").cast("bigint").alias("total_customers"),
    )
    return k.withColumn("avg_order_value", F.round(ratio("total_revenue", "total_orders"), 6))


def label_counts(df: DataFrame, col: str, out: str = "count", share: bool = True) -> DataFrame:
    """A10: rows per label (null labels dropped), count descending, with percent share."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias(out))
    if share:
        tot = c.agg(F.sum(out)).scalar()
        c = c.withColumn("share_pct", F.round(F.col(out) * 100.0 / tot, 6))
    return c.orderBy(F.desc(out), col)


def top_categories(fact: DataFrame, k: int = 10) -> DataFrame:
    """O1: the k categories with the largest price sum (ties by name)."""
    return (fact.groupBy(F.col("product_category_name_english").alias("category"))
            .agg(F.sum(money("price")).cast("double").alias("revenue"))
            .orderBy(F.desc("revenue"), "category").limit(k))


def top_states(fact: DataFrame, k: int = 10) -> DataFrame:
    """O2 (SQL text over the registered fact): top states by rounded revenue, with distinct orders."""
    spark = fact.sparkSession
    fact.select("customer_state", "price", "order_id").createOrReplaceTempView("fact_orders_states")
    return spark.sql(
        """
        SELECT customer_state, CAST(ROUND(SUM(CAST(price AS DECIMAL(18,2))), 2) AS DOUBLE) AS revenue,
               CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders
        FROM fact_orders_states GROUP BY customer_state
        ORDER BY revenue DESC, customer_state LIMIT :k
        """, args={"k": k})


def cumulative_revenue(fact: DataFrame) -> DataFrame:
    """Monthly revenue with its running total (window over the monthly table only)."""
    m = fact.where(F.col(TS).isNotNull()).groupBy(month_label(TS).alias("month")).agg(F.sum(money("price")).alias("_rev"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("month", F.col("_rev").cast("double").alias("revenue"),
                    F.sum("_rev").over(w).cast("double").alias("cumulative"))

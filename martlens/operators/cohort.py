"""Cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_label, month_start

TS = "order_purchase_timestamp"


def customer_months(fact: DataFrame, key: str = "customer_unique_id") -> DataFrame:
    """Distinct (customer, purchase month) pairs with the customer's first month
    (W1) and the whole months since it (W2).

    The first month is a window over the pairs, not over fact rows: one
    customer holds at most one row per calendar month, so no window group
    grows with the data even when one customer owns a third of all rows.
    """
    some = fact.where(F.col(key).isNotNull() & F.col(TS).isNotNull())  # null keys are no group
    cm = some.select(F.col(key), month_start(TS).alias("order_month")).distinct()
    cm = cm.withColumn("cohort_month", F.min("order_month").over(Window.partitionBy(key)))
    period = (F.lit(12) * (F.year("order_month") - F.year("cohort_month"))
              + F.month("order_month") - F.month("cohort_month"))
    return cm.withColumn("period_number", period.cast("bigint"))


def cohort_counts(fact: DataFrame, key: str = "customer_unique_id") -> DataFrame:
    """Distinct customers per (cohort month, months since)."""
    cm = customer_months(fact, key)
    return cm.groupBy(month_label("cohort_month").alias("cohort"), "period_number").agg(
        F.count(F.lit(1)).cast("bigint").alias("customers"))


def cohort_retention(fact: DataFrame, periods: int = 6, key: str = "customer_unique_id") -> DataFrame:
    """A13 (long form): retention % = round(customers / cohort size, 3) * 100
    (half-even), for the ``periods`` smallest period numbers present anywhere."""
    counts = cohort_counts(fact, key)
    size = counts.where(F.col("period_number") == 0).select("cohort", F.col("customers").alias("cohort_size"))
    kept = counts.select("period_number").distinct()  # at most one row per month offset
    kept = kept.withColumn("period_rank", F.dense_rank().over(Window.orderBy("period_number")))
    kept = kept.where(F.col("period_rank") <= periods)
    r = counts.join(F.broadcast(kept), "period_number").join(size, "cohort", "left")
    ret = F.bround(F.col("customers") / F.col("cohort_size"), 3) * F.lit(100.0)
    return r.select("cohort", "period_number", "period_rank", "customers", "cohort_size", ret.alias("retention_pct"))


def cohort_pivot(fact: DataFrame, periods: int = 6, value: str = "retention_pct", fill=None,
                 key: str = "customer_unique_id") -> DataFrame:
    """One row per cohort, one column per kept period (p0 = smallest present
    period number, p1 the next, ...); missing cells null, or ``fill``."""
    long = cohort_retention(fact, periods, key)
    cols = []
    for i in range(periods):
        c = F.max(F.when(F.col("period_rank") == i + 1, F.col(value)))
        if fill is not None:
            c = F.coalesce(c, F.lit(fill))
        cols.append(c.alias(f"p{i}"))
    return long.groupBy("cohort").agg(*cols)

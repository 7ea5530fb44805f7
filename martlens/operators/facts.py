"""Joins that build the order-line facts (J1, J2) and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money
from ..session import cut_lineage
from .kernels import join_unique

# A category-name table is a code list; broadcast it after checking its size.


def distinct_on_key(df: DataFrame, key: str) -> DataFrame:
    """Full-row distinct clustered on the join key: the hash partitioning on
    ``key`` satisfies both the distinct and the following join, so the table
    is shuffled once instead of twice."""
    return df.repartition(key).distinct()


def distinct_by_sort(df: DataFrame, key: str) -> DataFrame:
    """Full-row distinct by the sort that a join on ``key`` needs anyway: rows are hashed on ``key`` and sorted on
    all columns, and a row after an equal one is dropped.  No hash table holds the rows, so memory is that of one sort,
    and the join neither shuffles nor sorts them again."""
    again = F.lag(F.lit(1)).over(Window.partitionBy(key, *[c for c in df.columns if c != key]).orderBy(key))
    return df.repartition(key).withColumn("_again", again).where(F.col("_again").isNull()).drop("_again")


ORDER_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
              "order_delivered_customer_date", "order_estimated_delivery_date"]
ITEM_COLS = ["order_item_id", "product_id", "price", "freight_value"]
PAYMENT_COLS = ["payment_sequential", "payment_type", "payment_installments", "payment_value"]
CUSTOMER_COLS = ["customer_unique_id", "customer_state"]
PRODUCT_COLS = ["product_category_name"]
CATEGORY_COLS = ["product_category_name_english"]
WIDE_COLS = ORDER_COLS + ITEM_COLS + PAYMENT_COLS + CUSTOMER_COLS + PRODUCT_COLS + CATEGORY_COLS


def build_wide_fact(raw: dict[str, DataFrame], dedup: bool = True, split_hot: bool = False) -> DataFrame:
    """J1 (+C2): orders left-joined to items, payments, customers, products and
    category names; one row per (order, item, payment) — prices repeat once
    per payment row, as in the source pipeline.

    With ``dedup`` the fully-equal rows are dropped.  Left joins that keep every
    column are injective in their input rows, so the distinct of the joined
    rows equals the join of the distinct inputs: each input is made distinct on its own, clustered
    on its join key, and the items, the most numerous, by the sort that their join needs.

    Customers are joined to the orders and products to the items before these meet, so the joined
    rows, the widest and most numerous, are never shuffled and lie together by order.

    With ``split_hot`` the order lines are written and customers and products joined to them with
    hot keys in parts and null keys left out of the join (kernels.join_unique); otherwise skew is left to AQE.
    """
    orders = raw["orders"].select(*ORDER_COLS)
    items = raw["order_items"].select("order_id", *ITEM_COLS)
    payments = raw["payments"].select("order_id", *PAYMENT_COLS)
    customers = raw["customers"].select("customer_id", *CUSTOMER_COLS)
    products = raw["products"].select("product_id", *PRODUCT_COLS)
    category = raw["category"].select("product_category_name", *CATEGORY_COLS)
    if dedup:
        customers = distinct_on_key(customers, "customer_id")
        products = distinct_on_key(products, "product_id")
        category = category.distinct()
    # names go to the products first, so the fact is never hashed on a handful of category names
    named = products.join(category, "product_category_name", "left")
    if split_hot:
        if not dedup:
            raise ValueError("hot keys are split against dimensions of one row per key: dedup=True")
        orders, items, payments = distinct_on_key(orders, "order_id"), distinct_by_sort(items, "order_id"), distinct_on_key(payments, "order_id")
        core = orders.join(items, "order_id", "left").join(payments, "order_id", "left")
        spread = ["order_id", "order_item_id", "payment_sequential"]
        wide = join_unique(cut_lineage(core, "core"), customers, "customer_id", spread)
        wide = join_unique(cut_lineage(wide, "core"), named, "product_id", spread)
    else:
        orders = orders.join(customers, "customer_id", "left")
        items = items.join(named, "product_id", "left")
        if dedup:
            orders, items, payments = distinct_on_key(orders, "order_id"), distinct_by_sort(items, "order_id"), distinct_on_key(payments, "order_id")
        wide = orders.join(items, "order_id", "left").join(payments, "order_id", "left")
    return wide.select(*WIDE_COLS)


def build_item_fact(raw: dict[str, DataFrame]) -> DataFrame:
    """One row per (order, item) — payments are summed per order before
    the join, so item prices are never repeated."""
    orders = raw["orders"].select(*ORDER_COLS)
    items = raw["order_items"].select("order_id", *ITEM_COLS).distinct()
    pay = raw["payments"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_count"),
        F.sum(money("payment_value")).cast("double").alias("payment_value"),
        F.max("payment_installments").cast("bigint").alias("payment_installments"),
        F.min_by("payment_type", "payment_sequential").alias("payment_type"),
    )
    customers = raw["customers"].select("customer_id", *CUSTOMER_COLS)
    products = raw["products"].select("product_id", *PRODUCT_COLS)
    named = products.join(raw["category"].select("product_category_name", *CATEGORY_COLS), "product_category_name", "left")
    fact = (orders.join(items, "order_id", "left").join(pay, "order_id", "left")
            .join(customers, "customer_id", "left").join(named, "product_id", "left"))
    return fact.select(*ORDER_COLS, *ITEM_COLS, "payment_count", "payment_type", "payment_installments",
                       "payment_value", *CUSTOMER_COLS, *PRODUCT_COLS, *CATEGORY_COLS)


def key_check(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: rows, distinct keys and whether the key is unique (join fan-out check)."""
    k = df.select(*keys)
    per_key = k.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.agg(
        F.sum("_c").cast("bigint").alias("rows"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_keys"),
    ).select(F.lit(name).alias("table_name"), "rows", "distinct_keys",
             (F.col("rows") == F.col("distinct_keys")).alias("unique"))

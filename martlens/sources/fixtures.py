"""Retail-shaped views over the driver tables (FIXTURES.md §2).

The driver tables are TPC-H-like; the operators expect the retail order
shapes (orders, items, payments, customers, products, category names,
reviews).  Each view derives deterministically from the base tables with
key arithmetic only, so it grows with them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed fixture parameters (FIXTURES.md §2).
SNAPSHOT = dt.datetime(2001, 8, 2)
CHURN_DAYS = 180
REVIEW_EPOCH = dt.datetime(2018, 1, 1)

# Fixed test lexicon (term, valence) used by the sentiment job on the invented prose.
FX_LEXICON = [
    ("the", 0.1), ("of", -0.4), ("and", 0.6), ("to", -0.9), ("in", 1.3),
    ("that", -1.7), ("for", 2.1), ("was", -2.3), ("it", 0.8), ("on", -0.2),
]
# Boosters and negators that occur in the documents, for the rules of the sentiment score.
FX_MODIFIERS = [("by", 0.293, False), ("with", 0.293, False), ("at", -0.293, False), ("is", 0.0, True), ("are", 0.0, True)]


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def _days(n):
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str
    _memo: dict = field(default_factory=dict)

    def _t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def orders(self) -> DataFrame:
        o = self._t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        k = F.col("o_orderkey")
        d = F.col("o_orderdate")
        return o.select(
            k.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "O", "shipped")
            .otherwise("canceled").alias("order_status"),
            (d + _hours(k % 24)).alias("order_purchase_timestamp"),
            F.when(k % 7 == 0, F.lit(None)).otherwise(d + _hours(k % 24 + 1)).alias("order_approved_at"),
            F.when((F.col("o_orderstatus") == "F") & (k % 11 != 0),
                   d + _days(k % 71 - 2) + _hours(F.lit(10))).alias("order_delivered_customer_date"),
            (d + _days(F.lit(21))).alias("order_estimated_delivery_date"),
        )

    def order_items(self) -> DataFrame:
        li = self._t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        rows = li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_quantity") * F.lit(0.25)).alias("freight_value"),
        )
        # exact duplicate rows for every 50th order exercise the de-duplication
        return rows.unionByName(rows.where(F.col("order_id") % 50 == 0))

    def payments(self) -> DataFrame:
        o = self._t("orders").select("o_orderkey", "o_totalprice").where(F.col("o_orderkey") % 97 != 0)
        k = F.col("o_orderkey")
        first = o.select(
            k.alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.when(k % 4 == 0, "credit_card").when(k % 4 == 1, "boleto")
            .when(k % 4 == 2, "voucher").otherwise("debit_card").alias("payment_type"),
            (k % 10 + 1).alias("payment_installments"),
            F.col("o_totalprice").alias("payment_value"),
        )
        second = o.where(k % 10 == 0).select(
            k.alias("order_id"),
            F.lit(2).alias("payment_sequential"),
            F.lit("voucher").alias("payment_type"),
            F.lit(1).cast("bigint").alias("payment_installments"),
            F.lit(10.0).alias("payment_value"),
        )
        return first.unionByName(second)

    def customers(self) -> DataFrame:
        c = self._t("customer").select("c_custkey", "c_nationkey")
        n = self._t("nation").select("n_nationkey", "n_name")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        )

    def products(self) -> DataFrame:
        p = self._t("part").select("p_partkey", "p_type")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_partkey") % 40 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("product_category_name"),
        )

    def category_translation(self) -> DataFrame:
        p = self._t("part").select("p_type").where(F.col("p_type") != "PROMO").distinct()
        return p.select(
            F.col("p_type").alias("product_category_name"),
            F.lower("p_type").alias("product_category_name_english"),
        )

    def reviews(self) -> DataFrame:
        d = self._t("documents").select("doc_id", "text", "lang")
        lab = self._t("labels").select("doc_id", "quality", "toxic")
        j = d.join(lab, "doc_id", "left")
        q, t = F.col("quality"), F.col("toxic")
        return j.select(
            F.col("doc_id").alias("order_id"),
            F.when((q == 1) & (t == 0), 5).when(q == 1, 3)
            .when((q == 0) & (t == 0), 2).when(q == 0, 1).otherwise(4).alias("review_score"),
            F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("text")).alias("review_comment_message"),
            (F.lit(REVIEW_EPOCH).cast("timestamp_ntz") + _days(F.col("doc_id") % 400)).alias("review_creation_date"),
            F.col("lang"),
        )

    def lexicon(self) -> DataFrame:
        # a caller-given (term, valence) table; this one is the fixed test lexicon
        return self.spark.createDataFrame(FX_LEXICON, "term string, valence double")

    def modifiers(self) -> DataFrame:
        return self.spark.createDataFrame(FX_MODIFIERS, "term string, boost double, negator boolean")

    def raw(self) -> dict[str, DataFrame]:
        return {
            "orders": self.orders(),
            "order_items": self.order_items(),
            "payments": self.payments(),
            "customers": self.customers(),
            "products": self.products(),
            "category": self.category_translation(),
        }

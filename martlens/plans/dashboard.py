"""Dashboard datasets (the data behind every panel of the source's dashboards).

``dashboard(fact, rfm)`` returns name -> DataFrame; ``write_dashboard`` writes
each as a small Parquet table.  Chart drawing itself is not built.

All panels but the sample come from one scan of the fact: a lattice of grouping sets with rows and
revenue per node.  Its states merge: histograms are taken from counted values, and a
distinct count is the number of rows of a node that holds the counted id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WEEKDAYS, money, month_label, ratio
from ..operators import kernels as K
from ..operators import metrics as M
from ..session import checkpoint_dir

#: The grouping columns of the lattice and the sets of them that panels read.
KEYS = ("month", "day", "hour", "payment", "category", "price", "delivery_days", "order_id", "customer_unique_id")
NODES = ((), ("month",), ("day",), ("hour",), ("payment",), ("category",), ("price",), ("delivery_days",),
         ("month", "order_id"), ("day", "order_id"), ("order_id",), ("customer_unique_id",))


def _number(node: tuple[str, ...]) -> int:
    """What grouping_id() gives for a node: a bit for every column that is not in it, the first column's the highest."""
    return sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in node)


class Lattice:
    """Rows and revenue of every node, computed in one scan of the fact and written by node."""

    def __init__(self, fact: DataFrame):
        src = fact.select(
            month_label(M.TS).alias("month"), F.date_format(M.TS, "EEEE").alias("day"), F.hour(M.TS).cast("bigint").alias("hour"),
            F.col("payment_type").alias("payment"), F.col("product_category_name_english").alias("category"), "price", "delivery_days",
            "order_id", "customer_unique_id", money("price").alias("_money"))
        cells = src.groupingSets([list(n) for n in NODES], *KEYS).agg(
            F.grouping_id().cast("int").alias("node"), F.count(F.lit(1)).alias("n"), F.sum("_money").alias("revenue"))
        path = f"{checkpoint_dir(fact.sparkSession).rstrip('/')}/martlens-cut/lattice-{uuid.uuid4().hex}"
        cells.write.partitionBy("node").parquet(path)
        self._cells = fact.sparkSession.read.schema(cells.schema).parquet(path)

    def node(self, *keys: str) -> DataFrame:
        """The rows (keys, n, revenue) of one node; null keys are rows of their own."""
        return self._cells.where(F.col("node") == _number(keys)).select(*keys, "n", "revenue")

    def distinct(self, by: str, of: str) -> DataFrame:
        """(by, n): exact distinct values of ``of`` per value of ``by``, nulls not counted."""
        return self.node(by, of).groupBy(by).agg(F.count(of).alias("n"))


def dashboard(fact: DataFrame, rfm: DataFrame) -> dict[str, DataFrame]:
    """Every panel, equal to the query of its name."""
    lattice = Lattice(fact)
    money_by = {k: lattice.node(k).where(F.col(k).isNotNull()).select(k, F.col("revenue").cast("double").alias("revenue"))
                for k in ("month", "payment")}
    totals = lattice.node().agg(F.sum("revenue").cast("double").alias("total_revenue"))
    for out, key in (("total_orders", "order_id"), ("total_customers", "customer_unique_id")):
        totals = K.with_row(totals, lattice.node(key).agg(F.count(key).alias(out)))
    days = fact.sparkSession.createDataFrame([(i + 1, d) for i, d in enumerate(WEEKDAYS)], "day_index int, day string")
    weekday = days.join(lattice.node("day").select("day", F.col("n").alias("orders")), "day", "left").join(
        lattice.distinct("day", "order_id").withColumnRenamed("n", "distinct_orders"), "day", "left")
    months = lattice.node("month").where(F.col("month").isNotNull())
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    return {
        "kpis": totals.withColumn("avg_order_value", F.round(ratio("total_revenue", "total_orders"), 6)),
        "monthly_revenue": money_by["month"],
        "monthly_orders": lattice.distinct("month", "order_id").where(F.col("month").isNotNull()).select("month", F.col("n").alias("orders")),
        "top_categories": lattice.node("category").select("category", F.col("revenue").cast("double").alias("revenue")).orderBy(
            F.desc("revenue"), "category").limit(10),
        "rows_by_weekday": weekday.select("day_index", "day", "orders", "distinct_orders"),
        "revenue_by_payment": money_by["payment"],
        "segment_counts": M.label_counts(rfm, "Segment", "count"),
        "price_freight_sample": K.sample_n(
            fact.select("order_id", "order_item_id", "product_id", "payment_sequential", "price", "freight_value"),
            2000, "price-freight", ["order_id", "order_item_id", "product_id", "payment_sequential"], ["price", "freight_value"]),
        "cumulative_revenue": months.select("month", F.col("revenue").cast("double").alias("revenue"),
                                            F.sum("revenue").over(so_far).cast("double").alias("cumulative")),
        "delivery_histogram": K.histogram(lattice.node("delivery_days").where(F.col("delivery_days").between(0, 60)), "delivery_days", 40, weight="n"),
        "rows_by_hour": lattice.node("hour").where(F.col("hour").isNotNull()).select("hour", F.col("n").alias("order_count")).orderBy("hour"),
        "price_histogram": K.histogram(lattice.node("price"), "price", 60, weight="n"),
    }


def panel_rows(panels: dict[str, DataFrame]) -> DataFrame:
    """(panel, label, value) of the panels that come from the lattice, in one table."""
    parts = [panels["kpis"].select(F.explode(F.array(*[
        F.struct(F.lit("kpis").alias("panel"), F.lit(c).alias("label"), F.col(c).cast("double").alias("value"))
        for c in panels["kpis"].columns])).alias("x")).select("x.*")]
    for name, label, value in (
            ("monthly_revenue", "month", "revenue"), ("monthly_orders", "month", "orders"), ("top_categories", "category", "revenue"),
            ("rows_by_weekday", "day", "orders"), ("rows_by_weekday", "day", "distinct_orders"), ("revenue_by_payment", "payment", "revenue"),
            ("cumulative_revenue", "month", "cumulative"), ("delivery_histogram", "bin", "count"), ("rows_by_hour", "hour", "order_count"),
            ("price_histogram", "bin", "count")):
        parts.append(panels[name].select(F.lit(f"{name}.{value}").alias("panel"), F.col(label).cast("string").alias("label"),
                                         F.col(value).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_dashboard(panels: dict[str, DataFrame], base: str) -> None:
    for name, df in panels.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}")

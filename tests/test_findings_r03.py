"""Plans and rows of the steps that grew faster than their input."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlens.functions.columns import money
from martlens.operators import churn, experiment, facts, rfm, text


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _raw(spark):
    stamp = dt.datetime(2001, 1, 1)
    frame = spark.createDataFrame
    orders = [(1, 7, "delivered", stamp, stamp, None, None), (2, None, "delivered", stamp, None, None, None),
              (3, 8, "shipped", stamp, None, None, None), (None, 9, "delivered", stamp, None, None, None)]
    items = [(1, 1, 5, 2.5, 0.5), (1, 1, 5, 2.5, 0.5), (1, 2, None, 3.0, None), (2, 1, 99, 1.0, 0.0), (None, 1, 5, 9.0, 0.0)]
    pays = [(1, 1, "voucher", 1, 2.0), (1, 2, "boleto", None, 3.0), (2, 1, None, 1, 1.0), (2, 1, None, 1, 1.0), (None, 1, "x", 1, 1.0)]
    return {
        "orders": frame(orders + orders[:2], "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz, "
                        "order_approved_at timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"),
        "order_items": frame(items, "order_id long, order_item_id int, product_id long, price double, freight_value double"),
        "payments": frame(pays, "order_id long, payment_sequential int, payment_type string, payment_installments int, payment_value double"),
        "customers": frame([(7, 70, "A"), (7, 71, "B"), (8, 80, None), (8, 80, None), (9, 90, "C")],
                           "customer_id long, customer_unique_id long, customer_state string"),
        "products": frame([(5, "p"), (5, "p"), (6, None)], "product_id long, product_category_name string"),
        "category": frame([("p", "P"), ("p", "P"), ("q", "Q")], "product_category_name string, product_category_name_english string"),
    }


def _joined(raw):
    """J1 as it is written: every join over the whole rows, then one distinct."""
    wide = raw["orders"].join(raw["order_items"], "order_id", "left").join(raw["payments"], "order_id", "left")
    wide = wide.join(raw["customers"], "customer_id", "left").join(raw["products"], "product_id", "left")
    return wide.join(raw["category"], "product_category_name", "left").select(*facts.WIDE_COLS)


@pytest.mark.parametrize("dedup", [True, False])
def test_wide_fact_keeps_rows(spark, dedup):
    raw = _raw(spark)
    want = _joined(raw).distinct() if dedup else _joined(raw)
    key = lambda rows: sorted(map(repr, rows))
    assert key(facts.build_wide_fact(raw, dedup=dedup).collect()) == key(want.collect())


def test_joined_rows_are_not_shuffled(spark, no_broadcast):
    plan = facts.build_wide_fact(_raw(spark))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert all("order_id" in line for line in joins[:2])  # the last joins, on which no other exchange follows
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_customer_features_copy_no_rows(spark):
    stamp = [dt.datetime(2001, 1, d) for d in (1, 3, 5)]
    rows = [(1, 10, 1, 2.50, 0.5, "a", 3, 1, stamp[0]), (1, 10, 2, 4.00, None, "a", 3, 1, stamp[0]), (1, 11, 1, 1.00, 0.1, None, None, None, stamp[2]),
            (1, None, 1, 1.00, 0.1, "b", None, 2, stamp[1]), (2, 12, None, 7.00, 0.0, None, -1, 4, None), (None, 13, 1, 7.00, 0.0, "c", 1, 4, stamp[1])]
    fact = spark.createDataFrame(rows, "customer_unique_id long, order_id long, order_item_id int, price double, freight_value double, "
                                 "product_category_name_english string, delivery_days long, payment_installments long, order_purchase_timestamp timestamp_ntz")
    got = churn.customer_features(fact, dt.datetime(2001, 2, 1))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    plain = {r[0]: tuple(r)[1:] for r in fact.where("customer_unique_id is not null").groupBy("customer_unique_id").agg(
        F.countDistinct("order_id"), F.sum(money("price")).cast("double"), F.countDistinct("product_category_name_english"),
        F.round(F.avg("delivery_days"), 6), F.round(F.avg("order_item_id"), 6), F.round(F.avg("freight_value"), 6)).collect()}
    assert {r["customer_unique_id"]: (r["total_orders"], r["total_revenue"], r["unique_categories"], r["avg_delivery_days"],
                                      r["avg_items_order"], r["avg_freight"]) for r in got.collect()} == plain


def test_edge_check_selects_all_columns_at_once(spark, monkeypatch):
    calls, real = [], rfm.exact_quantiles
    monkeypatch.setattr(rfm, "exact_quantiles", lambda *a, **k: calls.append(1) or real(*a, **k))
    df = spark.createDataFrame([(i, 1.0 if i < 90 else None) for i in range(100)], "a long, b double")
    assert {tuple(r) for r in rfm.quintile_edge_check(df, ["a", "b"]).collect()} == {("a", 4), ("b", 1)}
    assert len(calls) == 1


def test_order_values_are_summed_once(spark):
    rows = spark.createDataFrame([(a, o, 100 * o + i) for a in "AB" for o in range(20) for i in range(3)], "arm string, order_id long, cents long")
    out = experiment.order_value_histogram(rows)
    assert "order_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["arm"]: r["n"] for r in out.groupBy("arm").agg(F.sum("count").alias("n")).collect()} == {"A": 20, "B": 20}


def test_training_tasks_level_off():
    assert [churn.layout_tasks(n) for n in (0, 49_999, 50_000, 600_000)] == [1, 1, 2, 13]
    assert churn.layout_tasks(4_000_000) == 21  # 81 tasks would each ship the statistics of all nodes


def test_look_back_evaluates_each_step_once():
    grown = str(text._look_back(F.col("running_valence"), lambda d: F.col(f"before{d}")))
    assert grown.count("running_valence") == 1


def test_topics_count_words_once(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    kept, real = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, d, *a: kept.append(d.storageLevel.useMemory and d.storageLevel.useDisk) or real(self, d, *a))
    scored = spark.createDataFrame([("red green blue",), ("red red blue",), ("green tea",)] * 5, "filtered_text string")
    vocab = spark.createDataFrame([("red", 0), ("green", 1), ("blue", 2)], "term string, term_index long")
    _, docs, _ = text.lda_topics(scored, vocab, k=2, passes=1)
    assert kept == [True] and docs.count() == 15

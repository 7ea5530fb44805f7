"""Parallel CSV reading, bucketed stages and distinct counts that merge."""

import random

import pytest
from pyspark.sql import functions as F

from martlens.operators import churn as CU
from martlens.operators import clean as C
from martlens.operators import states as D
from martlens.plans.catalog import CHURN_DAYS, SNAPSHOT, fact_by_customer
from martlens.plans.context import context
from martlens.sources import files as S

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "id string, text string, n int"


@pytest.fixture
def small_blocks(spark):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quoted_csv_in_blocks(spark, tmp_path, small_blocks):
    """Records of many lines, quotes, commas, blank lines, CRLF and BOM: the rows that the one-task reader gives."""
    rnd = random.Random(1)
    want = []
    for f in range(3):
        lines = ["﻿id,text,n" if f == 0 else "id,text,n"]
        end = "\r\n" if f == 1 else "\n"
        for i in range(120):
            text = "".join(rnd.choice(["a", "b c", ",", '"', "\n", "\n\n", "é", '""', "x" * 90]) for _ in range(rnd.randrange(1, 12)))
            want.append((f"{f}-{i}", text, i))
            lines.append(f'{f}-{i},"{text.replace(chr(34), chr(34) * 2)}",{i}')
        (tmp_path / f"r{f}.csv").write_bytes((end.join(lines) + end).encode())
    got = S.read_quoted_csv(spark, str(tmp_path), SCHEMA)
    assert rows(got) == sorted(want, key=str)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_quoted_csv_edges(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,n\n")
    assert S.read_quoted_csv(spark, str(tmp_path / "a.csv"), SCHEMA).count() == 0
    (tmp_path / "b.csv").write_text('id,text,n\n1,"one ""two""\nthree",3\n2,,4')
    assert rows(S.read_quoted_csv(spark, str(tmp_path / "b.csv"), SCHEMA)) == [("1", 'one "two"\nthree', 3), ("2", None, 4)]


def test_bucketed_stage_needs_no_shuffle(spark):
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as between tables too large to broadcast
    try:
        profile = CU.customer_profile(fact_by_customer(spark, SF_SMALL), SNAPSHOT, CHURN_DAYS)
        plan = profile._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    plain = CU.customer_profile(context(spark, SF_SMALL).fact(), SNAPSHOT, CHURN_DAYS)
    assert rows(profile) == rows(plain)


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_ROWS", 100)
    t = C.bucketed_stage(spark.range(1050).select((F.col("id") % 7).alias("k"), "id"), "t", "k")
    assert t.count() == 1050
    assert "hashpartitioning" not in t.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()


def test_distinct_states_merge_exactly(spark):
    """Three loads that share ids and groups, string ids, null ids and a null group."""
    rnd = random.Random(2)
    loads = [[(rnd.choice(["a", "b", None]), rnd.choice([None, *[f"id{k}" for k in range(40 * (i + 1))]])) for _ in range(300)] for i in range(3)]
    ids, states = None, []
    for load in loads:
        df = spark.createDataFrame(load, "g string, id_of string")
        before = {} if ids is None else {r["id"]: r["number"] for r in ids.collect()}
        ids = D.number_ids(df, "id_of", ids)
        now = {r["id"]: r["number"] for r in ids.collect()}
        assert before.items() <= now.items() and sorted(now.values()) == list(range(1, len(now) + 1))
        states.append(D.distinct_states(df, ["g"], "id_of", ids))
    got = {r["g"]: r["n"] for r in D.count_states(D.merge_states(states, ["g"]), ["g"], "n").collect()}
    assert got == {g: len({i for load in loads for h, i in load if h == g and i is not None}) for g in ("a", "b", None)}


def test_states_of_many_numbers(spark):
    """Numbers beyond one bitmap."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id"))
    ids = D.number_ids(df, "id")
    s = D.distinct_states(df, ["g"], "id", ids)
    assert s.count() == 4 and D.count_states(s, ["g"], "n").first()["n"] == 100_000


def test_hot_and_null_keys_leave_no_straggler(spark):
    """Half of the rows hold one key, a tenth none: the rows of a plain left join, and no task with many more than its share."""
    from martlens.operators.kernels import join_unique

    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 3).when(F.col("id") % 10 != 1, F.col("id") % 500).alias("k"))
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 500, 3)], "k int, v string")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    saved = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for c, v in zip(saved, ("false", "-1", "16")):
        spark.conf.set(c, v)
    try:
        got = join_unique(left, right, "k", ["id"])
        sizes = sorted(r["n"] for r in got.where("k is not null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        plain = left.join(right, "k", "left")
        one_task = max(r["n"] for r in plain.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert rows(got.select("id", "k", "v")) == rows(plain.select("id", "k", "v"))
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)
    assert one_task > 10_000 and sizes[-1] < 2 * 18_000 / 16, (one_task, sizes, aqe)

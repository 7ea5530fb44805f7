import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from martlens.operators.clean import DATE_COLS, parse_timestamps
from martlens.plans.dashboard import dashboard, write_dashboard
from martlens.plans.catalog import rfm_table
from martlens.plans.context import context
from martlens.sources.files import read_raw, read_table_file, register, run_sql, write_table


def test_csv_edge_with_bom_quotes_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="martlens-csv-")
    p = os.path.join(d, "category.csv")
    with open(p, "w", encoding="utf-8-sig", newline="") as fh:  # BOM before the header
        fh.write("product_category_name,product_category_name_english\nbeleza_saude,health_beauty\nmoveis,furniture")
    cat = read_raw(spark, "category", p)
    assert cat.columns == ["product_category_name", "product_category_name_english"]
    assert cat.count() == 2 and cat.where("product_category_name = 'moveis'").count() == 1
    r = os.path.join(d, "reviews.csv")
    with open(r, "w", encoding="utf-8", newline="") as fh:
        fh.write('review_id,order_id,review_score,review_comment_title,review_comment_message,'
                 'review_creation_date,review_answer_timestamp\n'
                 'r1,o1,5,,"muito bom\nchegou rápido, ""ótimo""",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
                 'r2,o2,1,,,2018-03-10 00:00:00,2018-03-11 03:05:13\n')
    rev = read_raw(spark, "reviews", r)
    rows = {x["review_id"]: x for x in rev.collect()}
    assert rows["r1"]["review_comment_message"] == 'muito bom\nchegou rápido, "ótimo"'
    assert rows["r2"]["review_comment_message"] is None and rows["r2"]["review_score"] == 1


def test_parse_timestamps_coerces_bad_text(spark):
    df = spark.createDataFrame([("2017-10-02 10:56:33", "not a date"), ("2018-01-01 00:00:00", None)],
                               "order_purchase_timestamp string, order_approved_at string")
    out = parse_timestamps(df, DATE_COLS).collect()
    assert out[0][0] == dt.datetime(2017, 10, 2, 10, 56, 33) and out[0][1] is None and out[1][1] is None


def test_write_read_register_and_sql(spark):
    d = tempfile.mkdtemp(prefix="martlens-out-")
    fact = context(spark, SF_SMALL).fact()
    write_table(fact.select("order_id", "price", "month"), f"{d}/fact", partition_by=["month"])
    back = read_table_file(spark, f"{d}/fact")
    assert back.count() == fact.count()
    register(back, "fact_test_view")
    n = run_sql(spark, "SELECT count(*) AS n FROM fact_test_view WHERE price > :p", {"p": 0}).first()["n"]
    assert n == fact.where("price > 0").count()


def test_dashboard_panels(spark):
    ctx = context(spark, SF_SMALL)
    panels = dashboard(ctx.fact(), rfm_table(spark, SF_SMALL))
    assert len(panels) == 12
    d = tempfile.mkdtemp(prefix="martlens-dash-")
    write_dashboard({"kpis": panels["kpis"]}, d)
    assert spark.read.parquet(f"{d}/kpis").count() == 1
    assert panels["rows_by_weekday"].count() == 7
    assert panels["price_histogram"].agg(F.sum("count")).first()[0] == ctx.fact().count()


def test_remove_intermediates(spark, tmp_path):
    """Only what lies in the session's own checkpoint folder goes."""
    from martlens import session

    sc = spark.sparkContext
    saved = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path / "ckpt"))
    try:
        own = sc.getCheckpointDir()
        assert session.cut_lineage(spark.range(3), "x").count() == 3
        (tmp_path / "other").mkdir()
        session.remove_intermediates(spark)
        import os

        assert os.listdir(own.removeprefix("file:")) == [] and (tmp_path / "other").exists()
    finally:
        if saved:
            sc._jsc.sc().setCheckpointDir(os.path.dirname(saved))


def test_every_panel_equals_its_query(spark):
    """The panels of the one-scan lattice are the results of the queries of their names, and the fact is read for the lattice and the sample only."""
    from martlens.plans.catalog import QUERIES, rfm_table

    ctx = context(spark, SF_SMALL)
    panels = dashboard(ctx.fact(), rfm_table(spark, SF_SMALL))
    fact_files = set(ctx.fact().inputFiles())
    for name, df in panels.items():
        want = QUERIES[name](spark, SF_SMALL)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        assert sorted(map(str, df.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect())), name
        if name != "price_freight_sample":
            assert not fact_files & set(df.inputFiles()), name


def test_lattice_of_null_keys(spark):
    """Null keys of the fact are rows of their own nodes and no month, payment or order; an order in two months counts in both."""
    ctx = context(spark, SF_SMALL)
    from martlens.operators import metrics as M
    from martlens.plans.dashboard import Lattice

    f = ctx.fact().limit(300)
    f = f.withColumn(M.TS, F.when(F.col("order_id") % 5 != 0, F.col(M.TS))).withColumn(
        "payment_type", F.when(F.col("order_id") % 3 != 0, F.col("payment_type"))).withColumn("order_id", F.when(F.col("order_id") % 7 != 0, F.col("order_id") % 11))
    f = f.cache()
    lattice = Lattice(f)
    for got, want in ((lattice.distinct("month", "order_id").where("month is not null").toDF("month", "orders"), M.monthly_orders(f)),
                      (lattice.node("payment").where("payment is not null").selectExpr("payment", "cast(revenue as double) as revenue"), M.revenue_by_payment(f))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert lattice.node("month").where("month is null").first()["n"] == f.where(F.col(M.TS).isNull()).count()
    f.unpersist()

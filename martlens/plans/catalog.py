"""Named queries over the driver tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics as M
from .context import context

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("monthly_revenue")
def q_monthly_revenue(spark, sf_dir):
    return M.monthly_revenue(context(spark, sf_dir).fact())


# ---- sources, joins, cleaning -------------------------------------------------
from ..operators import clean as C  # noqa: E402
from ..operators import facts as J  # noqa: E402
from ..operators import kernels as K  # noqa: E402
from ..sources import files as S  # noqa: E402


@query("wide_fact")
def q_wide_fact(spark, sf_dir):
    return context(spark, sf_dir).wide(dedup=True)


@query("item_fact")
def q_item_fact(spark, sf_dir):
    return J.build_item_fact(context(spark, sf_dir).raw())


@query("join_key_checks")
def q_join_key_checks(spark, sf_dir):
    raw = context(spark, sf_dir).raw()
    parts = [J.key_check(raw["customers"], ["customer_id"], "customers"),
             J.key_check(raw["products"], ["product_id"], "products"),
             J.key_check(raw["category"], ["product_category_name"], "category"),
             J.key_check(raw["order_items"], ["order_id", "order_item_id"], "order_items")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dedup_report")
def q_dedup_report(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return C.dedup_report(ctx.wide(dedup=False), ctx.wide(dedup=True))


@query("null_profile")
def q_null_profile(spark, sf_dir):
    return C.null_profile(context(spark, sf_dir).wide(dedup=True))


@query("table_shape")
def q_table_shape(spark, sf_dir):
    return S.table_shape(context(spark, sf_dir).raw())


@query("preview_orders")
def q_preview_orders(spark, sf_dir):
    o = context(spark, sf_dir).fx.orders().select("order_id", "customer_id", "order_status")
    return S.preview(o, 3, "order_id")


@query("clean_fact")
def q_clean_fact(spark, sf_dir):
    return context(spark, sf_dir).fact()


@query("delivery_days_in_range")
def q_delivery_days_in_range(spark, sf_dir):
    f = C.between_days(context(spark, sf_dir).fact(), "delivery_days", 0, 60)
    return f.groupBy("delivery_days").count().withColumnRenamed("count", "rows")


# ---- dashboard / EDA aggregates -------------------------------------------------
@query("monthly_orders")
def q_monthly_orders(spark, sf_dir):
    return M.monthly_orders(context(spark, sf_dir).fact())


@query("rows_by_weekday")
def q_rows_by_weekday(spark, sf_dir):
    return M.rows_by_weekday(context(spark, sf_dir).fact())


@query("rows_by_hour")
def q_rows_by_hour(spark, sf_dir):
    return M.rows_by_hour(context(spark, sf_dir).fact())


@query("revenue_by_payment")
def q_revenue_by_payment(spark, sf_dir):
    return M.revenue_by_payment(context(spark, sf_dir).fact())


@query("payment_breakdown")
def q_payment_breakdown(spark, sf_dir):
    return M.payment_breakdown(context(spark, sf_dir).fact())


@query("kpis")
def q_kpis(spark, sf_dir):
    return M.kpis(context(spark, sf_dir).fact())


@query("top_categories")
def q_top_categories(spark, sf_dir):
    return M.top_categories(context(spark, sf_dir).fact(), 10)


@query("top_states")
def q_top_states(spark, sf_dir):
    return M.top_states(context(spark, sf_dir).fact(), 10)


@query("cumulative_revenue")
def q_cumulative_revenue(spark, sf_dir):
    return M.cumulative_revenue(context(spark, sf_dir).fact())


@query("price_histogram")
def q_price_histogram(spark, sf_dir):
    return K.histogram(context(spark, sf_dir).fact(), "price", 60)


@query("delivery_histogram")
def q_delivery_histogram(spark, sf_dir):
    f = C.between_days(context(spark, sf_dir).fact(), "delivery_days", 0, 60)
    return K.histogram(f, "delivery_days", 40)


SAMPLE_SALT = "price-freight"


@query("price_freight_sample")
def q_price_freight_sample(spark, sf_dir):
    f = context(spark, sf_dir).fact().select("order_id", "order_item_id", "product_id", "payment_sequential",
                                             "price", "freight_value")
    keys = ["order_id", "order_item_id", "product_id", "payment_sequential"]
    return K.sample_n(f, 2000, SAMPLE_SALT, keys, ["price", "freight_value"])


# ---- RFM and cohorts --------------------------------------------------------------
from ..operators import cohort as CH  # noqa: E402
from ..operators import rfm as R  # noqa: E402
from ..sources.fixtures import SNAPSHOT  # noqa: E402


def rfm_table(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("rfm_segments", lambda: R.rfm_segments(ctx.fact(), SNAPSHOT))


@query("rfm_base")
def q_rfm_base(spark, sf_dir):
    return R.rfm_base(context(spark, sf_dir).fact(), SNAPSHOT)


@query("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return rfm_table(spark, sf_dir)


@query("rfm_describe")
def q_rfm_describe(spark, sf_dir):
    return R.describe_exact(R.rfm_base(context(spark, sf_dir).fact(), SNAPSHOT), ["recency", "frequency", "monetary"])


@query("rfm_edge_check")
def q_rfm_edge_check(spark, sf_dir):
    return R.quintile_edge_check(R.rfm_base(context(spark, sf_dir).fact(), SNAPSHOT), ["recency", "monetary"])


@query("segment_counts")
def q_segment_counts(spark, sf_dir):
    return M.label_counts(rfm_table(spark, sf_dir), "Segment", "count")


@query("cohort_counts")
def q_cohort_counts(spark, sf_dir):
    return CH.cohort_counts(context(spark, sf_dir).fact())


@query("cohort_retention")
def q_cohort_retention(spark, sf_dir):
    return CH.cohort_retention(context(spark, sf_dir).fact(), 6)


@query("cohort_pivot")
def q_cohort_pivot(spark, sf_dir):
    return CH.cohort_pivot(context(spark, sf_dir).fact(), 6)


# ---- two-arm experiment --------------------------------------------------------------
from ..operators import experiment as X  # noqa: E402


def exp_arms(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("exp_arms", lambda: X.assign_arms(ctx.fact().select(X.KEY)))


def exp_rows(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("exp_rows", lambda: X.experiment_rows(ctx.fact(), exp_arms(spark, sf_dir)))


@query("arm_assignment")
def q_arm_assignment(spark, sf_dir):
    return exp_arms(spark, sf_dir)


@query("experiment_rows")
def q_experiment_rows(spark, sf_dir):
    r = exp_rows(spark, sf_dir)
    return r.select("arm", X.KEY, *X.ROW_KEYS, (r.cents / 100.0).alias("price"), "origin")


@query("conversion")
def q_conversion(spark, sf_dir):
    return X.conversion(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir))


@query("chi_square")
def q_chi_square(spark, sf_dir):
    return X.chi_square_2x2(X.conversion(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


@query("order_values")
def q_order_values(spark, sf_dir):
    ov = X.order_values(exp_rows(spark, sf_dir))
    return ov.select("arm", "order_id", (ov.cents / 100.0).alias("order_value"))


@query("aov_lift")
def q_aov_lift(spark, sf_dir):
    return X.aov_lift(exp_rows(spark, sf_dir))


@query("welch_t")
def q_welch_t(spark, sf_dir):
    return X.welch_t(X.order_values(exp_rows(spark, sf_dir)))


@query("customer_revenue")
def q_customer_revenue(spark, sf_dir):
    c = X.customer_revenue(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir))
    return c.select("arm", X.KEY, (c.cents / 100.0).alias("revenue"))


@query("revenue_lift")
def q_revenue_lift(spark, sf_dir):
    return X.revenue_lift(X.customer_revenue(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


@query("mann_whitney")
def q_mann_whitney(spark, sf_dir):
    return X.mann_whitney_u(X.customer_revenue(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


@query("cohens_d")
def q_cohens_d(spark, sf_dir):
    return X.cohens_d(X.customer_revenue(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


@query("required_sample_size")
def q_required_sample_size(spark, sf_dir):
    return X.required_sample_size(X.conversion(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


def exp_all(spark, sf_dir):
    """The experiment over all rows of the customer table: most customers never buy, so conversion is live."""
    ctx = context(spark, sf_dir)
    arms = ctx.stage("exp_all_arms", lambda: X.assign_arms(ctx.raw()["customers"].select(X.KEY)))
    return ctx.stage("exp_all_rows", lambda: X.experiment_rows(ctx.fact(), arms)), arms


@query("conversion_all_customers")
def q_conversion_all_customers(spark, sf_dir):
    return X.conversion(*exp_all(spark, sf_dir))


@query("chi_square_all_customers")
def q_chi_square_all_customers(spark, sf_dir):
    return X.chi_square_2x2(X.conversion(*exp_all(spark, sf_dir)))


@query("required_sample_size_all_customers")
def q_required_sample_size_all_customers(spark, sf_dir):
    return X.required_sample_size(X.conversion(*exp_all(spark, sf_dir)))


@query("ab_summary_all_customers")
def q_ab_summary_all_customers(spark, sf_dir):
    return X.ab_summary(*exp_all(spark, sf_dir))


@query("lift_table_all_customers")
def q_lift_table_all_customers(spark, sf_dir):
    return X.lift_table(X.ab_summary(*exp_all(spark, sf_dir)))


@query("ab_summary")
def q_ab_summary(spark, sf_dir):
    return X.ab_summary(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir))


@query("lift_table")
def q_lift_table(spark, sf_dir):
    return X.lift_table(X.ab_summary(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


@query("order_value_histogram")
def q_order_value_histogram(spark, sf_dir):
    return X.order_value_histogram(exp_rows(spark, sf_dir))


@query("revenue_box_stats")
def q_revenue_box_stats(spark, sf_dir):
    return X.revenue_box_stats(X.customer_revenue(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir)))


# ---- churn --------------------------------------------------------------------------
from ..operators import churn as CU  # noqa: E402
from ..sources.fixtures import CHURN_DAYS  # noqa: E402


def churn_table(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("churn_matrix", lambda: CU.churn_matrix(ctx.fact(), SNAPSHOT, CHURN_DAYS))


def churn_split(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("churn_split", lambda: CU.stratified_split(churn_table(spark, sf_dir)))


def fixed_predictions(spark, sf_dir):
    return CU.fixed_score(churn_table(spark, sf_dir))


@query("churn_labels")
def q_churn_labels(spark, sf_dir):
    return CU.churn_labels(context(spark, sf_dir).fact(), SNAPSHOT, CHURN_DAYS)


@query("churn_rate")
def q_churn_rate(spark, sf_dir):
    return CU.churn_rate(CU.churn_labels(context(spark, sf_dir).fact(), SNAPSHOT, CHURN_DAYS))


@query("customer_features")
def q_customer_features(spark, sf_dir):
    return CU.customer_features(context(spark, sf_dir).fact(), SNAPSHOT)


@query("churn_matrix")
def q_churn_matrix(spark, sf_dir):
    return churn_table(spark, sf_dir)


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return churn_split(spark, sf_dir).select(CU.KEY, "churn", "part")


@query("auc_fixed_score")
def q_auc_fixed_score(spark, sf_dir):
    return CU.auc(fixed_predictions(spark, sf_dir))


@query("roc_fixed_score")
def q_roc_fixed_score(spark, sf_dir):
    return CU.roc_points(fixed_predictions(spark, sf_dir))


@query("confusion_fixed_score")
def q_confusion_fixed_score(spark, sf_dir):
    return CU.confusion(fixed_predictions(spark, sf_dir))


@query("class_report_fixed_score")
def q_class_report_fixed_score(spark, sf_dir):
    return CU.class_report(fixed_predictions(spark, sf_dir))


@query("probability_histogram_fixed_score")
def q_probability_histogram_fixed_score(spark, sf_dir):
    return CU.probability_histogram(fixed_predictions(spark, sf_dir))


@query("recency_orders_by_class")
def q_recency_orders_by_class(spark, sf_dir):
    return churn_table(spark, sf_dir).select(CU.KEY, "recency", "total_orders", "churn")


# ---- review text -------------------------------------------------------------------
from ..operators import text as T  # noqa: E402


def scored_reviews(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("scored_reviews", lambda: T.review_sentiment(ctx.fx.reviews(), ctx.fx.lexicon()))


@query("clean_reviews")
def q_clean_reviews(spark, sf_dir):
    return T.clean_reviews(context(spark, sf_dir).fx.reviews()).select("order_id", "review_score", "clean_comment")


@query("review_sentiment")
def q_review_sentiment(spark, sf_dir):
    return scored_reviews(spark, sf_dir).select("order_id", "review_score", "sentiment_score", "sentiment")


@query("filtered_tokens")
def q_filtered_tokens(spark, sf_dir):
    return scored_reviews(spark, sf_dir).select("order_id", "filtered_text")


@query("sentiment_counts")
def q_sentiment_counts(spark, sf_dir):
    return M.label_counts(scored_reviews(spark, sf_dir), "sentiment", "count")


@query("sentiment_by_score")
def q_sentiment_by_score(spark, sf_dir):
    return T.sentiment_by_score(scored_reviews(spark, sf_dir))


@query("score_counts")
def q_score_counts(spark, sf_dir):
    return T.score_counts(context(spark, sf_dir).fx.reviews())


@query("sentiment_by_month")
def q_sentiment_by_month(spark, sf_dir):
    return T.sentiment_by_month(scored_reviews(spark, sf_dir))


@query("term_frequencies")
def q_term_frequencies(spark, sf_dir):
    return T.term_frequencies(scored_reviews(spark, sf_dir), 80)


@query("bag_of_words_vocabulary")
def q_bag_of_words_vocabulary(spark, sf_dir):
    return T.vocabulary(scored_reviews(spark, sf_dir), 1000, 5, 0.8)


# ---- models (rows-only checks: no SQL oracle can fit a forest or a topic model) ------------
from pyspark.sql import functions as F  # noqa: E402


def fitted_models(spark, sf_dir):
    ctx = context(spark, sf_dir)
    with ctx_lock():
        if "models" not in ctx._stages:
            ctx._stages["models"] = CU.fit_models(churn_split(spark, sf_dir))
        return ctx._stages["models"]


def ctx_lock():
    from .context import _LOCK
    return _LOCK


def test_predictions(spark, sf_dir, name):
    test = churn_split(spark, sf_dir).where(F.col("part") == "test")
    return CU.score(fitted_models(spark, sf_dir)[name], test).withColumnRenamed("churn", "label")


MODEL_NAMES = ["Logistic Regression", "Random Forest", "Gradient Boosting"]


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("model_test_auc")
def q_model_test_auc(spark, sf_dir):
    rows = CU.auc(_union([test_predictions(spark, sf_dir, n).select(F.lit(n).alias("model"), "score", "label") for n in MODEL_NAMES]), by=["model"])
    from pyspark.sql import Window

    best = F.row_number().over(Window.orderBy(F.desc("auc"), "model")) == 1  # three rows
    return rows.withColumn("best", best)


@query("model_cv_auc")
def q_model_cv_auc(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx.stage("model_cv_auc", lambda: CU.cv_auc(churn_table(spark, sf_dir)))


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    return q_model_test_auc(spark, sf_dir).join(q_model_cv_auc(spark, sf_dir), "model")


@query("model_class_report")
def q_model_class_report(spark, sf_dir):
    return _union([CU.class_report(test_predictions(spark, sf_dir, n)).select(F.lit(n).alias("model"), "*")
                   for n in MODEL_NAMES])


@query("model_roc_points")
def q_model_roc_points(spark, sf_dir):
    every = _union([test_predictions(spark, sf_dir, n).select(F.lit(n).alias("model"), "score", "label") for n in MODEL_NAMES])
    return CU.roc_points(every, by=["model"], drop_collinear=True)


@query("best_model_confusion")
def q_best_model_confusion(spark, sf_dir):
    best = q_model_test_auc(spark, sf_dir).where("best").select("model")
    return _union([CU.confusion(test_predictions(spark, sf_dir, n)).select(F.lit(n).alias("model"), "*")
                   for n in MODEL_NAMES]).join(best, "model", "left_semi")


@query("best_model_probability_histogram")
def q_best_model_probability_histogram(spark, sf_dir):
    best = q_model_test_auc(spark, sf_dir).where("best").select("model")
    return _union([CU.probability_histogram(test_predictions(spark, sf_dir, n)).select(F.lit(n).alias("model"), "*")
                   for n in MODEL_NAMES]).join(best, "model", "left_semi")


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return CU.feature_importance(fitted_models(spark, sf_dir)["Random Forest"], CU.FEATURES, spark, 12)


@query("score_customers")
def q_score_customers(spark, sf_dir):
    m = churn_table(spark, sf_dir)
    s = CU.score(fitted_models(spark, sf_dir)["Random Forest"], CU.class_weights(m))
    return s.select(CU.KEY, "recency", "total_orders", "total_revenue", "churn",
                    F.round("score", 6).alias("churn_probability"))


def topic_model(spark, sf_dir):
    ctx = context(spark, sf_dir)
    with ctx_lock():
        if "lda" not in ctx._stages:
            scored = scored_reviews(spark, sf_dir)
            vocab = ctx.stage("vocabulary", lambda: q_bag_of_words_vocabulary(spark, sf_dir))
            ctx._stages["lda"] = (T.lda_topics(scored, vocab), vocab)
        return ctx._stages["lda"]


@query("topic_words")
def q_topic_words(spark, sf_dir):
    (model, _, _), vocab = topic_model(spark, sf_dir)
    return T.topic_words(model, vocab, 10)


@query("topic_weights")
def q_topic_weights(spark, sf_dir):
    (model, _, _), vocab = topic_model(spark, sf_dir)
    return T.topic_words(model, vocab, 7).where(F.col("topic") < 3).drop("topic_label")


@query("dominant_topic")
def q_dominant_topic(spark, sf_dir):
    (model, docs, _), _ = topic_model(spark, sf_dir)
    return T.dominant_topic(model, docs)


@query("topic_counts")
def q_topic_counts(spark, sf_dir):
    return q_dominant_topic(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).cast("bigint").alias("reviews")).orderBy("topic")


@query("sentiment_results")
def q_sentiment_results(spark, sf_dir):
    (model, docs, _), _ = topic_model(spark, sf_dir)
    return T.dominant_topic(model, docs, ["order_id", "review_score", "sentiment", "sentiment_score"])


@query("english_review_sentiment")
def q_english_review_sentiment(spark, sf_dir):
    """The README's English-only scoring (the code it mirrors scores every language)."""
    ctx = context(spark, sf_dir)
    s = T.review_sentiment(ctx.fx.reviews(), ctx.fx.lexicon(), lang="en")
    return s.select("order_id", "review_score", "sentiment_score", "sentiment")


# ---- null keys: rows without a date or a customer belong to no group -----------------
def null_key_fact(spark, sf_dir):
    """The clean fact with the purchase date of every seventh and the customer of every eleventh order missing."""
    f = context(spark, sf_dir).fact()
    return (f.withColumn(M.TS, F.when(F.col("order_id") % 7 != 0, F.col(M.TS)))
            .withColumn(X.KEY, F.when(F.col("order_id") % 11 != 0, F.col(X.KEY))))


for _name, _build in {"monthly_revenue": M.monthly_revenue, "monthly_orders": M.monthly_orders, "rows_by_hour": M.rows_by_hour,
                      "cumulative_revenue": M.cumulative_revenue, "cohort_counts": CH.cohort_counts,
                      "churn_labels": lambda f: CU.churn_labels(f, SNAPSHOT, CHURN_DAYS)}.items():
    QUERIES[f"{_name}_null_keys"] = lambda spark, sf_dir, build=_build: build(null_key_fact(spark, sf_dir))


@query("model_metrics_no_recency")
def q_model_metrics_no_recency(spark, sf_dir):
    """M7 on the matrix without `recency`, which is the label in disguise."""
    ctx = context(spark, sf_dir)
    cols = [c for c in CU.FEATURES if c != "recency"]

    def build():
        split = CU.stratified_split(CU.churn_matrix(ctx.fact(), SNAPSHOT, CHURN_DAYS, exclude=["recency"]))
        split = ctx.stage("churn_split_no_recency", lambda: split)
        fitted = CU.fit_models(split, cols)
        test = split.where(F.col("part") == "test")
        return _union([CU.auc(CU.score(m, test).withColumnRenamed("churn", "label")).select(F.lit(n).alias("model"), "auc")
                       for n, m in fitted.items()])

    return ctx.stage("model_metrics_no_recency", build)


# ---- facts of the model and topic queries that SQL can compute ------------------------
@query("fold_sizes")
def q_fold_sizes(spark, sf_dir):
    """M8: customers per class and fold of the cross-validation."""
    return CU.fold_column(churn_table(spark, sf_dir)).groupBy("churn", "fold").agg(
        F.count(F.lit(1)).cast("bigint").alias("customers"))


@query("model_support")
def q_model_support(spark, sf_dir):
    """Test customers per true class, from each model's confusion counts."""
    return _union([CU.confusion(test_predictions(spark, sf_dir, n)).groupBy("actual").agg(
        F.sum("count").cast("bigint").alias("support")).select(F.lit(n).alias("model"), "actual", "support")
        for n in MODEL_NAMES])


@query("scored_customer_total")
def q_scored_customer_total(spark, sf_dir):
    """Rows scored by the forest, per class."""
    return q_score_customers(spark, sf_dir).groupBy("churn").agg(F.count("churn_probability").cast("bigint").alias("scored"))


@query("topic_count_total")
def q_topic_count_total(spark, sf_dir):
    """Comments over all topics."""
    return q_topic_counts(spark, sf_dir).agg(F.sum("reviews").cast("bigint").alias("reviews"))


# ---- file edges: text dates, quoted newlines, SQL over registered frames ---------------
def _csv_folder(spark, name):
    import uuid

    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/martlens-csv/{name}-{uuid.uuid4().hex}"


@query("csv_orders_by_month")
def q_csv_orders_by_month(spark, sf_dir):
    """S6 -> S1 -> C1 -> S8 -> S9: orders through a CSV with text dates, some of them no dates."""
    ctx = context(spark, sf_dir)

    def build():
        o = ctx.raw()["orders"]
        stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        text = o.select(*[F.col(c).cast("string").alias(c) for c in ("order_id", "customer_id", "order_status")],
                        F.when(F.col("order_id") % 50 == 0, "no date").otherwise(stamp(M.TS)).alias(M.TS),
                        stamp("order_approved_at").alias("order_approved_at"), F.lit(None).cast("string").alias("order_delivered_carrier_date"),
                        stamp("order_delivered_customer_date").alias("order_delivered_customer_date"),
                        stamp("order_estimated_delivery_date").alias("order_estimated_delivery_date"))
        path = _csv_folder(spark, "orders")
        S.write_table(text, path, "csv")
        return C.parse_timestamps(S.read_raw(spark, "orders", path), C.DATE_COLS)

    S.register(ctx.stage("csv_orders", build), "csv_orders")
    return S.run_sql(spark, """
        SELECT date_format(order_purchase_timestamp, 'yyyy-MM') AS month, CAST(COUNT(*) AS BIGINT) AS orders,
               CAST(COUNT(order_approved_at) AS BIGINT) AS approved, CAST(COUNT(order_delivered_customer_date) AS BIGINT) AS delivered
        FROM csv_orders GROUP BY 1""")


@query("csv_review_scores")
def q_csv_review_scores(spark, sf_dir):
    """S7 -> S4 -> S8 -> S9: comments with quoted newlines through a CSV."""
    ctx = context(spark, sf_dir)

    def build():
        none = F.lit(None).cast("string")
        text = ctx.fx.reviews().select(
            F.col("order_id").cast("string").alias("review_id"), F.col("order_id").cast("string").alias("order_id"), "review_score",
            none.alias("review_comment_title"), "review_comment_message",
            F.date_format("review_creation_date", "yyyy-MM-dd").alias("review_creation_date"), none.alias("review_answer_timestamp"))
        path = _csv_folder(spark, "reviews")
        S.write_table(text, path, "csv")
        return S.read_raw(spark, "reviews", path)

    S.register(ctx.stage("csv_reviews", build), "csv_reviews")
    return S.run_sql(spark, """
        SELECT review_score, CAST(COUNT(*) AS BIGINT) AS reviews, CAST(COUNT(review_comment_message) AS BIGINT) AS comments,
               CAST(SUM(length(review_comment_message)) AS BIGINT) AS chars,
               CAST(SUM(length(review_comment_message) - length(replace(review_comment_message, chr(10), ''))) AS BIGINT) AS newlines
        FROM csv_reviews GROUP BY review_score""")


@query("review_sentiment_rules")
def q_review_sentiment_rules(spark, sf_dir):
    """N3 with boosters, negators and a contrast word that occur in the comments."""
    ctx = context(spark, sf_dir)
    c = T.clean_reviews(ctx.fx.reviews())
    s = T.lexicon_sentiment(c, ctx.fx.lexicon(), modifiers=ctx.fx.modifiers(), contrast="as")
    return s.select("order_id", "review_score", "sentiment_score")


@query("review_sentiment_large_lexicon")
def q_review_sentiment_large_lexicon(spark, sf_dir):
    """N3 with a word table made of the comments' own tokens, joined by shuffle as a table of any size is."""
    ctx = context(spark, sf_dir)
    # one copy of the texts for the word table and the scores, in the blocks in which they are scored
    c = ctx.stage_as("clean_comments", lambda: T.text_blocks(
        T.clean_reviews(ctx.fx.reviews()).select("order_id", "review_score", "clean_comment")))
    s = T.lexicon_sentiment(c, T.corpus_lexicon(c), modifiers=ctx.fx.modifiers(), contrast="as", max_broadcast=0)
    return s.select("order_id", "review_score", "sentiment_score")


def fixed_by_fold(spark, sf_dir):
    """The model-free score of every customer with its fold: five evaluations in one table."""
    m = CU.fold_column(churn_table(spark, sf_dir))
    return CU.fixed_score(m).join(m.select(CU.KEY, "fold"), CU.KEY)


@query("auc_by_fold_fixed_score")
def q_auc_by_fold_fixed_score(spark, sf_dir):
    """M7 of all folds in one segmented pass."""
    return CU.auc(fixed_by_fold(spark, sf_dir), by=["fold"])


@query("roc_bends_fixed_score")
def q_roc_bends_fixed_score(spark, sf_dir):
    """M12 as it is drawn: without points on a straight line."""
    return CU.roc_points(fixed_predictions(spark, sf_dir), drop_collinear=True)


@query("roc_bends_by_fold_fixed_score")
def q_roc_bends_by_fold_fixed_score(spark, sf_dir):
    return CU.roc_points(fixed_by_fold(spark, sf_dir), by=["fold"], drop_collinear=True)


@query("mann_whitney_top_customers")
def q_mann_whitney_top_customers(spark, sf_dir):
    """X9 in its exact form: the eight customers of greatest revenue of each arm."""
    cust = X.customer_revenue(exp_rows(spark, sf_dir), exp_arms(spark, sf_dir))
    top = K.top_k_per_group(cust, ["arm"], [F.desc("cents"), F.asc(X.KEY)], X.EXACT_ARM, [X.KEY])
    return X.mann_whitney_u(top)


@query("price_round_histogram")
def q_price_round_histogram(spark, sf_dir):
    """A24 with the round bin widths that a drawing picks for at most 60 bins."""
    return K.round_histogram(context(spark, sf_dir).fact(), "price", 60)


@query("delivery_round_histogram")
def q_delivery_round_histogram(spark, sf_dir):
    return K.round_histogram(C.between_days(context(spark, sf_dir).fact(), "delivery_days", 0, 60), "delivery_days", 40)


@query("dashboard_panels")
def q_dashboard_panels(spark, sf_dir):
    """Every dashboard panel over the fact, from one scan of it."""
    from .dashboard import dashboard, panel_rows

    return panel_rows(dashboard(context(spark, sf_dir).fact(), rfm_table(spark, sf_dir)))


@query("csv_review_scores_parallel")
def q_csv_review_scores_parallel(spark, sf_dir):
    """S4 with quoted newlines, read block by block."""
    ctx = context(spark, sf_dir)

    def build():
        none = F.lit(None).cast("string")
        text = ctx.fx.reviews().select(
            F.col("order_id").cast("string").alias("review_id"), F.col("order_id").cast("string").alias("order_id"), "review_score",
            none.alias("review_comment_title"), "review_comment_message",
            F.date_format("review_creation_date", "yyyy-MM-dd").alias("review_creation_date"), none.alias("review_answer_timestamp"))
        path = _csv_folder(spark, "reviews")
        S.write_table(text, path, "csv")
        return S.read_quoted_csv(spark, path, S.RAW_SCHEMAS["reviews"])

    r = ctx.stage("csv_reviews_parallel", build)
    breaks = F.length("review_comment_message") - F.length(F.replace("review_comment_message", F.lit("\n"), F.lit("")))
    return r.groupBy("review_score").agg(
        F.count(F.lit(1)).alias("reviews"), F.count("review_comment_message").alias("comments"),
        F.sum(F.length("review_comment_message")).cast("bigint").alias("chars"), F.sum(breaks).cast("bigint").alias("newlines"))


def fact_by_customer(spark, sf_dir):
    """The clean fact bucketed on the customer, written once per session."""
    ctx = context(spark, sf_dir)
    return ctx.stage_as("fact_by_customer", lambda: C.bucketed_stage(ctx.fact(), "fact_by_customer", CU.KEY))


@query("customer_profile")
def q_customer_profile(spark, sf_dir):
    """J3, A8 and A14 off the bucketed fact."""
    return CU.customer_profile(fact_by_customer(spark, sf_dir), SNAPSHOT, CHURN_DAYS)


from ..operators import states as D  # noqa: E402


def _two_loads(spark, sf_dir):
    """The fact as two loads that share orders, customers and months."""
    f = context(spark, sf_dir).fact().withColumn("month", F.date_format(M.TS, "yyyy-MM")).where(F.col("month").isNotNull())
    return f.where(F.col("order_item_id") % 2 == 0), f.where((F.col("order_item_id") % 2 != 0) | F.col("order_item_id").isNull())


def _merged_counts(spark, sf_dir, by, col, out):
    first, second = _two_loads(spark, sf_dir)
    ids = D.number_ids(first, col)
    early = D.distinct_states(first, by, col, ids)
    ids = D.number_ids(second, col, ids)
    return D.count_states(D.merge_states([early, D.distinct_states(second, by, col, ids)], by), by, out)


@query("monthly_orders_merged")
def q_monthly_orders_merged(spark, sf_dir):
    """A2 from the states of two loads."""
    return _merged_counts(spark, sf_dir, ["month"], "order_id", "orders")


@query("monthly_customers_merged")
def q_monthly_customers_merged(spark, sf_dir):
    """Distinct customers per month from the states of two loads."""
    return _merged_counts(spark, sf_dir, ["month"], "customer_unique_id", "customers")


@query("revenue_by_state_hot_customer")
def q_revenue_by_state_hot_customer(spark, sf_dir):
    """J1 where one customer holds half of all orders and a seventh of the others have none."""
    raw = dict(context(spark, sf_dir).raw())
    key = F.when(F.col("order_id") % 2 == 0, F.lit(1).cast("bigint")).when(F.col("order_id") % 7 != 0, F.col("customer_id"))
    raw["orders"] = raw["orders"].withColumn("customer_id", key)
    wide = J.build_wide_fact(raw, split_hot=True)
    return wide.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("customer_unique_id").alias("customers"),
        F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("revenue"))

"""Churn labels, customer features and model evaluation.

Labels and features are one grouped pass each over the fact; evaluation
metrics (AUC, ROC, confusion, per-class report) are exact and distributed
(rank sums from the prefix-sum kernel).  Models are MLlib estimators: the
driver only loops over three estimators, the work runs as Spark jobs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_key, md5_unit, money, whole_days
from .clean import impute_median
from ..session import cut_lineage
from .kernels import exact_median_columns, global_row_number, histogram, join_groups, neighbours, prefix_sum, with_row

KEY = "customer_unique_id"
TS = "order_purchase_timestamp"
# The feature names of the churn matrix, in order.
FEATURES = ["total_orders", "total_revenue", "avg_order_value", "max_order_value", "min_order_value",
            "total_items", "avg_items_order", "total_freight", "avg_freight", "unique_categories",
            "avg_delivery_days", "payment_installments", "recency", "days_active", "purchase_frequency",
            "revenue_per_order"]


def churn_labels(fact: DataFrame, snapshot: dt.datetime, days: int = 180, key: str = KEY) -> DataFrame:
    """Last purchase, whole days since it at the snapshot, churn = days > threshold.

    Rows without a customer are dropped; a customer without any date is not churned."""
    snap = F.lit(snapshot).cast("timestamp_ntz")
    g = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(TS).alias("last_purchase"))
    ds = whole_days(F.col("last_purchase"), snap)
    return g.select(key, F.date_format("last_purchase", "yyyy-MM-dd HH:mm:ss").alias("last_purchase"),
                    ds.alias("days_since"), F.coalesce(ds > days, F.lit(False)).cast("int").alias("churn"))


def churn_rate(labels: DataFrame) -> DataFrame:
    """Customers per class with the overall churn rate (%)."""
    c = labels.groupBy("churn").agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
    return c.withColumn("churn_rate_pct", labels.agg(F.round(F.avg("churn") * 100.0, 6)).scalar())


def customer_features(fact: DataFrame, snapshot: dt.datetime, key: str = KEY) -> DataFrame:
    """A16 + A17: 14 grouped features and two ratios per customer.

    (avg_order_value is the mean item price and avg_items_order the mean item
    ordinal, as in the source.)  Money means are exact decimal sums / counts.

    The rows are summed per order first, which the writers of the fact's files do for whole orders before
    anything is shuffled; the customer's numbers are taken from those sums.  Two distinct counts in one aggregation
    would copy every row three times instead.
    """
    snap = F.lit(snapshot).cast("timestamp_ntz")
    f = fact.where(F.col(key).isNotNull())
    sums = {"price": money("price"), "freight_value": money("freight_value"),
            **{c: F.col(c).cast("decimal(38,6)") for c in ("order_item_id", "delivery_days", "payment_installments")}}
    per_order = f.groupBy(key, "order_id").agg(
        *[F.sum(x).alias(f"_s_{c}") for c, x in sums.items()], *[F.count(c).alias(f"_n_{c}") for c in sums],
        F.max("price").alias("_hi"), F.min("price").alias("_lo"), F.max(TS).alias("_last"), F.min(TS).alias("_first"))
    categories = f.select(key, "product_category_name_english").distinct().groupBy(key).agg(
        F.count("product_category_name_english").cast("bigint").alias("unique_categories"))

    def total(c):
        return F.sum(f"_s_{c}").cast("double")

    def mean(c):
        return total(c) / F.sum(f"_n_{c}")

    g = per_order.groupBy(key).agg(
        F.count("order_id").cast("bigint").alias("total_orders"),
        total("price").alias("total_revenue"),
        mean("price").alias("avg_order_value"),
        F.max("_hi").alias("max_order_value"),
        F.min("_lo").alias("min_order_value"),
        F.sum("_n_order_item_id").cast("bigint").alias("total_items"),
        mean("order_item_id").alias("avg_items_order"),
        total("freight_value").alias("total_freight"),
        mean("freight_value").alias("avg_freight"),
        mean("delivery_days").alias("avg_delivery_days"),
        mean("payment_installments").alias("payment_installments"),
        whole_days(F.max("_last"), snap).alias("recency"),
        whole_days(F.min("_first"), F.max("_last")).alias("days_active"),
    ).join(categories, key)
    g = g.withColumn("purchase_frequency", F.col("total_orders") / (F.col("days_active") + 1))
    g = g.withColumn("revenue_per_order", F.col("total_revenue") / F.col("total_orders"))
    return g.select(key, *[F.round(F.col(c).cast("double"), 6).alias(c) if c not in
                           ("total_orders", "total_items", "unique_categories", "recency", "days_active")
                           else F.col(c) for c in FEATURES])


def customer_profile(fact: DataFrame, snapshot: dt.datetime, days: int = 180, key: str = KEY) -> DataFrame:
    """J3 over A8 and A14: recency, frequency, monetary and churn of every customer.

    Over a fact bucketed on the customer all three are read off its buckets, without a shuffle."""
    from .rfm import rfm_base

    return rfm_base(fact, snapshot, key).join(churn_labels(fact, snapshot, days, key).select(key, "last_purchase", "churn"), key)


def churn_matrix(fact: DataFrame, snapshot: dt.datetime, days: int = 180, key: str = KEY,
                 exclude: Sequence[str] = (), fit_on: str = "all") -> DataFrame:
    """J3 + C16 + M1 input: features joined to labels, every feature's nulls
    filled with its exact median.  ``fit_on='all'`` takes the medians over all
    customers as the source does (test rows included); ``'train'`` takes them
    over the training part of ``stratified_split`` only."""
    # the label is a function of the feature `recency` (both are days since the last purchase), so one
    # aggregation gives both; written once, as the medians and the rows read it
    feats = customer_features(fact, snapshot, key)
    m = cut_lineage(feats.withColumn("churn", F.coalesce(F.col("recency") > days, F.lit(False)).cast("int")), "features")
    cols = [c for c in FEATURES if c not in exclude]
    basis = m
    if fit_on == "train":
        basis = stratified_split(m, key=key).where(F.col("part") == "train")
    elif fit_on != "all":
        raise ValueError("fit_on is 'all' or 'train'")
    med = exact_median_columns(basis, cols)
    m = impute_median(m, cols, med)
    return m.select(key, *[F.round(c, 6).alias(c) for c in cols], "churn")


def stratified_split(m: DataFrame, test_share: float = 0.2, salt: str = "split", key: str = KEY,
                     label: str = "churn") -> DataFrame:
    """M2: per label, the first ceil(share x class size) ids in md5(salt|id) order
    are the test part ('test'), the rest 'train' (exact class shares)."""
    h = m.withColumn("_h", md5_key(salt, key))
    ranked = global_row_number(h, [label, "_h", key], "_rn")
    g = ranked.groupBy(label).agg(F.min("_rn").alias("_r0"), F.count(F.lit(1)).alias("_n"))
    j = join_groups(ranked, g, [label])
    pos = F.col("_rn") - F.col("_r0") + 1
    part = F.when(pos <= F.ceil(F.lit(test_share) * F.col("_n")), "test").otherwise("train")
    return j.withColumn("part", part).drop("_h", "_rn", "_r0", "_n")


def fold_column(m: DataFrame, k: int = 5, salt: str = "fold", key: str = KEY, label: str = "churn") -> DataFrame:
    """M8 folds (0..k-1), stratified: each class is dealt out in md5 order of the id, so its
    counts in the folds differ by at most one."""
    ranked = global_row_number(m.withColumn("_h", md5_key(salt, key)), [label, "_h", key], "_rn")
    g = ranked.groupBy(label).agg(F.min("_rn").alias("_r0"))
    j = join_groups(ranked, g, [label])
    return j.withColumn("fold", F.pmod(F.col("_rn") - F.col("_r0"), F.lit(k)).cast("int")).drop("_h", "_rn", "_r0")


# ---- exact evaluation ----------------------------------------------------------------

def _score_counts(pred: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count(F.lit(1)).alias("_t"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"))


def auc(pred: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """M7: ROC AUC = (R1 - n1(n1+1)/2) / (n1 n0), R1 = sum of average ranks of
    positives (ties share a rank); one row per group of ``by``, null with one class only.

    All groups take one pass: the running count goes on over the groups, in their order, and what a
    group started from is taken off its rank sum at the end."""
    by = list(by)
    cum = prefix_sum(_score_counts(pred, score, label, by), [*by, "_s"], "_t", "_before")
    twice = (2 * F.col("_before") + F.col("_t") + 1).cast("decimal(19,0)")  # of the average rank
    s = cum.groupBy(*by).agg(
        (F.sum(F.col("_p").cast("decimal(19,0)") * twice)
         - F.sum("_p").cast("decimal(19,0)") * (2 * F.min("_before")).cast("decimal(19,0)")).alias("r2"),
        F.sum("_p").cast("double").alias("n1"), (F.sum("_t") - F.sum("_p")).cast("double").alias("n0"))
    a = F.try_divide(F.col("r2").cast("double") / 2.0 - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))
    return s.select(*by, F.round(a, 6).alias("auc"))


def roc_points(pred: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (),
               drop_collinear: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (score >= threshold is
    positive), plus the (inf, 0, 0) start, per group of ``by``.

    With ``drop_collinear`` the points between two others on one straight line are left out, the first
    and last score always kept: what a drawing needs, so the output follows the bends of the curve and not the scores."""
    by = list(by)
    sc = _score_counts(pred, score, label, by).withColumn("_neg_cnt", F.col("_t") - F.col("_p"))
    order = [*by, "_desc"]
    cn = prefix_sum(sc.withColumn("_desc", -F.col("_s")), order, ["_p", "_neg_cnt"], ["_p_before", "_n_before"], keep_partition="_part")
    if by:
        own = cn.groupBy(*by).agg(F.min("_p_before").alias("_p0"), F.min("_n_before").alias("_n0"),
                                  F.sum("_p").alias("_tot_pos"), F.sum("_neg_cnt").alias("_tot_neg"))
        j = join_groups(cn, own, by)
    else:
        j = with_row(cn, sc.agg(F.sum("_p").alias("_tot_pos"), F.sum("_neg_cnt").alias("_tot_neg"))).withColumns(
            {"_p0": F.lit(0), "_n0": F.lit(0)})
    j = j.withColumns({"_fp": F.col("_n_before") - F.col("_n0") + F.col("_neg_cnt"), "_tp": F.col("_p_before") - F.col("_p0") + F.col("_p")})
    if drop_collinear:
        j = neighbours(j, "_part", order, [*by, "_fp", "_tp"])
        before, after = F.col("_prev"), F.col("_next")
        same = [(before[c] == F.col(c)) & (after[c] == F.col(c)) for c in by]
        straight = ((before["_fp"] + after["_fp"] == 2 * F.col("_fp")) & (before["_tp"] + after["_tp"] == 2 * F.col("_tp")))
        for c in same:
            straight = straight & c
        j = j.where(~F.coalesce(straight, F.lit(False)))
    pts = j.select(*by, F.col("_s").alias("threshold"),
                   F.round(F.try_divide(F.col("_fp"), F.col("_tot_neg")), 6).alias("fpr"),
                   F.round(F.try_divide(F.col("_tp"), F.col("_tot_pos")), 6).alias("tpr"))
    start = sc.groupBy(*by).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2x2 counts, all four cells present."""
    grid = pred.sparkSession.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    c = pred.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    return grid.join(c, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                 names: Sequence[str] = ("Active", "Churned")) -> DataFrame:
    """M9: precision, recall, F1, support per class, accuracy, macro and weighted averages."""
    cm = confusion(pred, label, prediction)
    w = cm.groupBy().agg(*[F.max(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("count")))
                           .cast("double").alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])
    rows = []
    for k, name in enumerate(names):
        tp = F.col(f"c{k}{k}")
        fp = F.col(f"c{1 - k}{k}")
        fn = F.col(f"c{k}{1 - k}")
        prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), (tp + fn).alias("support")))
    per = w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tot = w.select((F.col("c00") + F.col("c11")).alias("_ok"),
                   (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")).alias("_n"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("_ok") / F.col("_n")).alias("f1"),
                     F.col("_n").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                       F.sum("support").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def fixed_score(m: DataFrame, key: str = KEY) -> DataFrame:
    """A deterministic model-free score (md5 noise plus capped recency, 3 decimals, so ties
    occur) used to check the evaluation operators against SQL without a fitted model."""
    s = F.round(md5_unit("score", key) * 0.6 + F.least(F.col("recency"), F.lit(400)) / 400.0 * 0.4, 3)
    return m.select(key, F.col("churn").alias("label"), s.alias("score"),
                    (s >= 0.5).cast("int").alias("prediction"))


def probability_histogram(pred: DataFrame, score: str = "score", label: str = "label", bins: int = 40) -> DataFrame:
    """Histogram of predicted probability per true class, bins over [0, 1]."""
    return histogram(pred, score, bins, by=[label], lo=0.0, hi=1.0)


# ---- models (MLlib) ----------------------------------------------------------------

#: A forest over more training rows than this grows TREES_AT_A_TIME trees at a time.
WHOLE_FOREST_ROWS = 100_000
TREES_AT_A_TIME = 50


class PartedForest(RandomForestClassifier):
    """MLlib's random forest, grown some trees at a time and joined to one model.

    What MLlib keeps for a forest follows rows x trees (each row's share in each tree's sample, the node it stands in),
    and a task counts the open nodes of all trees at once.  Parts draw with seeds of their own, so a forest in parts is another draw
    than one grown whole; one part is MLlib's own fit."""

    at_a_time: int | None = None

    def _fit(self, dataset):
        trees = self.getNumTrees()
        size = min(self.at_a_time or trees, trees)
        if size == trees:
            return super()._fit(dataset)
        # every part reads the assembled rows: kept, not read and assembled anew
        rows = dataset.select(*dict.fromkeys([self.getLabelCol(), self.getWeightCol(), self.getFeaturesCol()])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            parts = [RandomForestClassifier._fit(self.copy({self.numTrees: min(size, trees - k), self.seed: self.getSeed() + k}), rows)
                     for k in range(0, trees, size)]
        finally:
            rows.unpersist()
        return self._joined(parts)

    def _joined(self, parts):
        sc = SparkContext._active_spark_context
        ml, first = sc._jvm.org.apache.spark.ml.classification, parts[0]._java_obj
        trees = [t for p in parts for t in p._java_obj.trees()]
        array = sc._gateway.new_array(ml.DecisionTreeClassificationModel, len(trees))
        for i, t in enumerate(trees):
            array[i] = t
        whole = ml.RandomForestClassificationModel(first.uid(), array, first.numFeatures(), first.numClasses())
        model = self._copyValues(self._create_model(whole))
        model._transfer_params_to_java()
        return model


def _models(n_train: int, features: Sequence[str]):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    lr = Pipeline(stages=[asm, StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                          LogisticRegression(featuresCol="scaled", labelCol="churn", maxIter=1000,
                                             regParam=1.0 / max(n_train, 1), elasticNetParam=0.0)])
    # the node of each row is kept from level to level (the same trees; looked up from the root otherwise)
    forest = PartedForest(featuresCol="features", labelCol="churn", numTrees=200, maxDepth=10, featureSubsetStrategy="sqrt", weightCol="w",
                          seed=42, maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=-1)
    forest.at_a_time = TREES_AT_A_TIME if n_train > WHOLE_FOREST_ROWS else None
    rf = Pipeline(stages=[asm, forest])
    gb = Pipeline(stages=[asm, GBTClassifier(featuresCol="features", labelCol="churn", maxIter=100, maxDepth=5,
                                             stepSize=0.1, seed=42)])
    return {"Logistic Regression": lr, "Random Forest": rf, "Gradient Boosting": gb}


def class_weights(m: DataFrame, label: str = "churn") -> DataFrame:
    """'balanced' weights n / (2 n_class) as a column w."""
    c = m.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    nt = m.agg(F.count(F.lit(1))).scalar()
    w = c.select(label, (nt / (2.0 * F.col("_nc"))).alias("w"))
    return join_groups(m, w, [label])


def positive_probability(scored: DataFrame) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col("probability")).getItem(1)


ROWS_PER_TASK = 50_000
#: Beyond so many tasks another one comes with every ROWS_PER_LATER_TASK rows: a task of a tree fit ships the statistics of
#: all open nodes whatever its rows, so what a fit shuffles follows the number of tasks.
FIRST_TASKS, ROWS_PER_LATER_TASK = 12, 500_000


def layout_tasks(rows: int) -> int:
    """Tasks for so many training rows: one per ROWS_PER_TASK up to FIRST_TASKS, then one per ROWS_PER_LATER_TASK."""
    return 1 + min(rows // ROWS_PER_TASK, FIRST_TASKS + rows // ROWS_PER_LATER_TASK)


def stable_layout(df: DataFrame, key: str = KEY) -> DataFrame:
    """Hash partitions on the id, sorted inside and written: the same input layout on every run, so
    seeded bootstrap / subsampling repeats exactly, and the estimators' passes read a table.

    The number of partitions follows the rows alone (see layout_tasks)."""
    rows = cut_lineage(df, "train")
    n = layout_tasks(rows.count())
    return cut_lineage(rows.repartition(n, key).sortWithinPartitions(key), "train")


def fit_models(split: DataFrame, features: Sequence[str] = FEATURES) -> dict:
    """M3-M6: fit the three estimators on the train part, at the same time: each is a chain of short Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    train = stable_layout(class_weights(split.where(F.col("part") == "train")))
    models = _models(train.count(), features)
    with ThreadPoolExecutor(max_workers=len(models)) as pool:
        return dict(zip(models, pool.map(lambda est: est.fit(train), models.values())))


def score(model, df: DataFrame) -> DataFrame:
    s = model.transform(df)
    return s.withColumn("score", positive_probability(s)).withColumn("prediction", F.col("prediction").cast("int"))


def cv_auc(m: DataFrame, features: Sequence[str] = FEATURES, k: int = 5, parallelism: int = 5) -> DataFrame:
    """M8: k-fold mean AUC of each estimator on the whole table (folds by md5
    bucket).  Fold fits are independent Spark jobs, submitted concurrently."""
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce

    folded = cut_lineage(fold_column(m, k), "folds")
    sizes = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())

    def laid_out(f):
        # weights of the training part alone: the test fold tells the fit nothing
        return stable_layout(class_weights(folded.where(F.col("fold") != f)))

    def predicted(name_fold):
        name, f = name_fold
        est = _models(total - sizes.get(f, 0), features)[name]
        pred = score(est.fit(trains[f]), folded.where(F.col("fold") == f))
        return pred.select(F.lit(name).alias("model"), F.lit(f).alias("fold"), F.col("churn").alias("label"), "score")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trains = list(pool.map(laid_out, range(k)))  # one layout a fold, read by all estimators
        # fold by fold, so that one or two forests, which keep the most memory, grow at a time beside the boosted chains
        parts = list(pool.map(predicted, [(name, f) for f in range(k) for name in _models(1, features)]))
    per_fold = auc(reduce(DataFrame.unionByName, parts), by=["model", "fold"])  # all models and folds in one pass
    return per_fold.groupBy("model").agg(F.round(F.avg("auc"), 6).alias("cv_auc"))


def feature_importance(rf_pipeline_model, features: Sequence[str], spark, k: int = 12) -> DataFrame:
    """Forest importances with names, top k (the vector is model state, one per feature)."""
    imp = rf_pipeline_model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)

"""The registered queries, each a function of (spark, data folder)."""

from __future__ import annotations

import hashlib
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.expressions import binary_flag, binary_flag_except, linear_score, logistic, quadrant
from cohortlab.operators import (
    audit,
    balance,
    curves,
    eda,
    explain,
    kernel_svm,
    metrics,
    models,
    neighbors,
    prep,
    random_trees,
    sampling,
    services,
)
from cohortlab.operators.kernel_shap import kernel_attributions
from cohortlab.plans import experiments as ex
from cohortlab.plans import fixed_scores
from cohortlab.session import materialize, ship_package
from cohortlab.sources import cohorts
from cohortlab.sources.cohorts import DOCUMENTS, ORDERS, VECTORS
from cohortlab.sources.tables import RunCache, read_table
from cohortlab.streaming import scoring

LEAN = ORDERS.without_leakage()
ID, TARGET = ORDERS.id_col, ORDERS.target
USER_THRESHOLD = 0.65
TUNED_THRESHOLD = 0.6
AGE_LIKE = "qty"
SHARED_WIDTH = 10.0
REPORT_TIME = "2024-01-01 12:00:00"
REPORT_FACTORS = 10
ROOT_TREES = 10
CHECKED_LANDMARKS = 3
SVM_COALITIONS = 64
SVM_BACKGROUND = 20
SHOWN = ("n_lines", "qty", "total_cents")
BOX_FEATURES = ("gross_cents", "max_line_cents", "qty", "disc_pts", "tax_pts")


# --- inputs --------------------------------------------------------------------


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.order_cohort(spark, sf)


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return prep.encode_labels(cohort(spark, sf), ORDERS.categorical, read_table(spark, sf, "orders"))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded cohort with its split, written once for the jobs of one query."""
    return ex.prepare(cohort(spark, sf), ORDERS)


def split_of(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_scores.predictions(cohort(spark, sf), ID, TARGET)


def by_value(spark: SparkSession, sf: str) -> DataFrame:
    return curves.score_counts_by_value(scored(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as requests; those without line items lack the line features."""
    rows = cohorts.order_requests(spark, sf)
    return prep.encode_labels(rows, LEAN.categorical, read_table(spark, sf, "orders"))


def test_means(data: DataFrame) -> dict[str, float]:
    return eda.mean_values(split_of(data, "test"), LEAN.features)


def filled_requests(spark: SparkSession, sf: str, data: DataFrame) -> DataFrame:
    return services.fill_missing(requests(spark, sf), test_means(data))


def attributions(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    """Linear attributions of the test rows against the training means."""
    data = prepared(spark, sf)
    means = eda.mean_values(split_of(data, "train"), LEAN.features)
    table = explain.linear_attributions(split_of(data, "test"), ID, fixed_scores.RISK, means)
    return table, explain.linear_base(fixed_scores.RISK_INTERCEPT, fixed_scores.RISK, means)


def context(data: DataFrame, spec) -> models.Context:
    n_neg, n_pos = prep.class_counts(split_of(data, "train"), TARGET)
    return models.Context(ID, TARGET, list(spec.features), sampling.DEFAULT_SEED, n_neg, n_pos)


# --- audit and exploration -------------------------------------------------------


def audit_profile(spark, sf):
    return audit.profile(cohorts.order_requests(spark, sf))


def null_counts(spark, sf):
    return audit.null_counts(cohorts.order_requests(spark, sf))


def class_distribution(spark, sf):
    return audit.class_shares(cohort(spark, sf), TARGET, ORDERS.labels)


def category_distribution(spark, sf):
    return audit.distribution(cohort(spark, sf), "o_orderpriority")


def prevalence(spark, sf):
    return audit.prevalence(cohort(spark, sf), TARGET)


def majority_baseline(spark, sf):
    return audit.majority_baseline(cohort(spark, sf), TARGET)


def leakage_screen(spark, sf):
    return audit.leakage_screen(cohort(spark, sf), ORDERS)


def document_screen(spark, sf):
    return audit.leakage_screen(cohorts.document_cohort(spark, sf), DOCUMENTS)


def drop_leakage(spark, sf):
    df = cohort(spark, sf).drop(*ORDERS.drop, *ORDERS.leakage, "not_a_column")
    return df.select(ID, *LEAN.features, TARGET)


def hist_by_class(spark, sf):
    return eda.histogram_by_class(cohort(spark, sf), TARGET, AGE_LIKE)


def hist_shared(spark, sf):
    return eda.shared_histogram(cohort(spark, sf), TARGET, AGE_LIKE, SHARED_WIDTH)


def variance_top20(spark, sf):
    df = encoded(spark, sf)
    return eda.variance_ranking(df, [*ORDERS.features, TARGET])


def corr_lower(spark, sf):
    df = materialize(encoded(spark, sf).select(*ORDERS.features, TARGET), "corr")
    top = eda.variance_ranking(df, ORDERS.features).orderBy("rank").collect()
    return eda.correlation_lower(df, [*[r["feature"] for r in top], TARGET])


def box_stats(spark, sf):
    rows = materialize(cohort(spark, sf).select(TARGET, *BOX_FEATURES), "box")
    return eda.box_statistics(rows, TARGET, BOX_FEATURES)


def feature_direction(spark, sf):
    return eda.feature_direction(encoded(spark, sf), TARGET, ORDERS.features)


def column_means(spark, sf):
    return eda.column_means(encoded(spark, sf), ORDERS.features)


# --- sampling and preparation ------------------------------------------------------


def stratified_sample(spark, sf):
    return sampling.stratified_sample(cohort(spark, sf), ORDERS).select(ID, TARGET)


def stratified_split(spark, sf):
    return sampling.stratified_split(cohort(spark, sf), ORDERS).select(ID, TARGET, "split")


def stratified_folds(spark, sf):
    return sampling.stratified_folds(cohort(spark, sf), ORDERS).select(ID, TARGET, "fold")


def repeated_splits(spark, sf):
    base = materialize(cohort(spark, sf).select(ID, TARGET), "ids")
    return sampling.repeated_splits(base, ORDERS).select("run", ID, TARGET, "split")


def train_test_union(spark, sf):
    data = materialize(sampling.stratified_split(cohort(spark, sf), ORDERS), "split")
    parts = [split_of(data, s).select(ID, *LEAN.features, TARGET) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


def label_encode(spark, sf):
    return encoded(spark, sf).select(ID, "o_orderpriority")


def standard_scale(spark, sf):
    data = prepared(spark, sf)
    scaler = prep.Scaler.fit(split_of(data, "train"), LEAN.features)
    return data.select(ID, "split", *[F.round(scaler.scaled(c), 6).alias(f"z_{c}") for c in LEAN.features])


def class_weights(spark, sf):
    return prep.class_weights(cohort(spark, sf), TARGET)


def smote_neighbors(spark, sf):
    train = split_of(prepared(spark, sf), "train")
    near = balance.minority_neighbors(train, ID, TARGET, ORDERS.features, minority=0)
    return near.select(ID, "neighbor_rank", "neighbor_id", F.round(F.sqrt("d2"), 2).alias("distance"))


def _rounded_smote(spark, sf, spec, ratio):
    train = split_of(prepared(spark, sf), "train")
    out = balance.smote(train, ID, TARGET, spec.features, ratio)
    return out.select(
        ID,
        TARGET,
        "synthetic",
        F.coalesce("base_id", ID).alias("base_id"),
        F.coalesce("neighbor_id", ID).alias("neighbor_id"),
        *[F.round(c, 4).alias(c) for c in spec.features],
    )


def smote_resample(spark, sf):
    return _rounded_smote(spark, sf, ORDERS, balance.PARTIAL_RATIO)


def smote_full_balance(spark, sf):
    return _rounded_smote(spark, sf, LEAN, balance.FULL_RATIO)


# --- metrics and curves --------------------------------------------------------------


def confusion_counts(spark, sf):
    return metrics.confusion_counts(scored(spark, sf))


def _board(spark, sf):
    table = scored(spark, sf)
    return metrics.leaderboard(table, curves.roc_auc(curves.score_counts_by_value(table), metrics.DIGITS))


def leaderboard(spark, sf):
    return _board(spark, sf)


def board_view(spark, sf):
    return metrics.board_view(_board(spark, sf))


def headline(spark, sf):
    counts = metrics.confusion_counts(scored(spark, sf))
    n_used = counts.agg(F.max(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).first()[0]
    return metrics.headline(_board(spark, sf), "no_leakage", cohort(spark, sf).count(), n_used)


def best_model(spark, sf):
    return metrics.best_model(_board(spark, sf))


def leakage_drop(spark, sf):
    return metrics.leakage_drop(_board(spark, sf), "full", "no_leakage")


def experiment_comparison(spark, sf):
    names = ("balanced_accuracy", "macro_f1", "macro_recall")
    return metrics.side_by_side(_board(spark, sf), "full", "no_leakage", names, top=5)


def metrics_long(spark, sf):
    return metrics.metrics_long(metrics.leaderboard(scored(spark, sf)))


def accuracy_axis(spark, sf):
    return metrics.axis_minimum(metrics.leaderboard(scored(spark, sf)))


def classification_report(spark, sf):
    return metrics.classification_report(scored(spark, sf), ORDERS.labels)


def cv_scores(spark, sf):
    folded = sampling.stratified_folds(cohort(spark, sf), ORDERS)
    return metrics.fold_scores(fixed_scores.predictions(folded, ID, TARGET, ("fold",)))


def cv_accuracy(spark, sf):
    folded = sampling.stratified_folds(cohort(spark, sf), ORDERS)
    return metrics.fold_scores(fixed_scores.predictions(folded, ID, TARGET, ("fold",)), "accuracy")


def roc_auc(spark, sf):
    return curves.roc_auc(by_value(spark, sf))


def roc_curve(spark, sf):
    return curves.roc_curve(by_value(spark, sf))


def roc_curve_compact(spark, sf):
    return curves.roc_curve(by_value(spark, sf), drop_collinear=True)


def pr_curve(spark, sf):
    return curves.pr_curve(by_value(spark, sf))


def average_precision(spark, sf):
    return curves.average_precision(by_value(spark, sf))


def threshold_tuning(spark, sf):
    return metrics.threshold_table(scored(spark, sf))


def best_threshold(spark, sf):
    return metrics.best_threshold(metrics.threshold_table(scored(spark, sf)))


def metrics_at_threshold(spark, sf):
    return metrics.metrics_at(scored(spark, sf), USER_THRESHOLD)


def calibration(spark, sf):
    return curves.calibration_curve(scored(spark, sf))


def risk_histogram(spark, sf):
    return curves.risk_histogram(scored(spark, sf))


def error_rows(spark, sf):
    extra = tuple(c for c in LEAN.features)
    table = fixed_scores.predictions(cohort(spark, sf), ID, TARGET, extra)
    cell = quadrant(F.col("y"), F.col("yhat"))
    return table.withColumn("quadrant", cell).where(F.col("quadrant").isin("FP", "FN"))


def error_patterns(spark, sf):
    columns = ORDERS.features[:10]
    table = fixed_scores.predictions(cohort(spark, sf), ID, TARGET, columns)
    one = table.where((F.col("experiment") == "no_leakage") & (F.col("model") == "volume"))
    return metrics.error_patterns(one, columns)


def shuffled_sanity(spark, sf):
    return metrics.shuffled_label_check(scored(spark, sf))


# --- neighbours and closed-form models -------------------------------------------------


def knn_vote(spark, sf):
    data = prepared(spark, sf)
    scaler = prep.Scaler.fit(split_of(data, "train"), LEAN.features).rounded(6)
    train, test = (scaler.transform(split_of(data, s)) for s in ("train", "test"))
    return neighbors.knn_vote(test, train, LEAN.features, models.KNN_K, ID, TARGET)


def vector_neighbors(spark, sf):
    vectors = cohorts.vector_cohort(spark, sf)
    near = neighbors.knn_join(
        vectors, vectors, VECTORS.features, 5, "vec_id", "vec_id", exclude_self=True, carry=["target"]
    )
    return near.select(
        "vec_id",
        "neighbor_rank",
        "neighbor_id",
        F.col("nn_target").cast("int").alias("neighbor_target"),
        F.round(F.sqrt("d2"), 4).alias("distance"),
    )


def random_tree_cuts(spark, sf):
    """The first cut of each of ten random trees on the training part."""
    train = split_of(prepared(spark, sf), "train")
    grown = random_trees.grow(train, TARGET, LEAN.features, ROOT_TREES, 1, context(train, LEAN).seed)
    columns = "tree int, feature string, cut double, low_0 long, low_1 long, high_0 long, high_1 long"
    return spark.createDataFrame(random_trees.root_cuts(grown), columns)


def svm_residuals(spark, sf):
    """What the first three landmarks of the kernel machine leave unexplained of each training row."""
    train = split_of(prepared(spark, sf), "train")
    scaler = prep.Scaler.fit(train, LEAN.features)
    columns = [scaler.scaled(f) for f in LEAN.features]
    _, pool = kernel_svm.landmark_pool(train, ID, columns, sampling.DEFAULT_SEED)
    factor = kernel_svm.LandmarkFactor.choose(pool, 1.0 / len(columns), CHECKED_LANDMARKS)
    return train.select(ID, F.round(kernel_svm.residual_column(factor, columns), 6).alias("residual"))


def gaussian_nb(spark, sf):
    data = prepared(spark, sf)
    fitted = models.GaussianBayes.fit(split_of(data, "train"), TARGET, LEAN.features)
    out = fitted.score(split_of(data, "test"))
    return out.select(ID, F.col(TARGET).alias("y"), F.round("p", 5).alias("p"), "yhat")


# --- explanation -------------------------------------------------------------------------


def linear_shap(spark, sf):
    return attributions(spark, sf)[0]


def shap_global(spark, sf):
    return explain.global_importance(attributions(spark, sf)[0])


def shap_grouped(spark, sf):
    return explain.grouped_importance(attributions(spark, sf)[0], ORDERS.groups)


def shap_topn(spark, sf):
    return explain.top_factors(attributions(spark, sf)[0], ID, REPORT_FACTORS)


def shap_protective_risk(spark, sf):
    return explain.side_factors(attributions(spark, sf)[0], ID)


def shap_waterfall(spark, sf):
    table, base = attributions(spark, sf)
    return explain.waterfall(table, ID, base)


def shap_beeswarm(spark, sf):
    return explain.beeswarm(attributions(spark, sf)[0])


# --- services for single subjects ----------------------------------------------------------


def request_fill(spark, sf):
    return filled_requests(spark, sf, prepared(spark, sf)).select(ID, "n_filled", *LEAN.features)


def request_flags(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    flags = {
        "is_urgent": binary_flag(F.col("o_orderpriority"), "1-URGENT"),
        "is_open": binary_flag(F.col("o_orderstatus"), "O"),
        "not_filled": binary_flag_except(F.col("o_orderstatus"), "F"),
    }
    return services.request_flags(orders, flags)


def request_validation(spark, sf):
    return services.bound_violations(requests(spark, sf), ID, ORDERS.bounds)


def risk_tier(spark, sf):
    filled = filled_requests(spark, sf, prepared(spark, sf))
    out = services.assess(fixed_scores.score_risk(filled), TUNED_THRESHOLD)
    return out.select(ID, "p", "assessment.level", "assessment.action", "assessment.color", "decision")


def counterfactual(spark, sf):
    filled = filled_requests(spark, sf, prepared(spark, sf))
    return services.counterfactuals(filled, ID, LEAN.features, ORDERS.shifts, fixed_scores.score_risk)


def risk_percentile(spark, sf):
    data = prepared(spark, sf)
    asked = fixed_scores.score_risk(filled_requests(spark, sf, data))
    return curves.percentile_of(asked, fixed_scores.score_risk(split_of(data, "test")), ID)


def _similar(spark, sf, show=()):
    data = prepared(spark, sf)
    asked = materialize(filled_requests(spark, sf, data), "requests")
    return neighbors.similar_subjects(asked, split_of(data, "train"), LEAN.features, ID, TARGET, show=show)


def similar_subjects(spark, sf):
    return _similar(spark, sf, SHOWN)


def similar_outcomes(spark, sf):
    return neighbors.similar_outcomes(_similar(spark, sf), ID, TARGET)


def risk_report(spark, sf):
    """Report records, flattened to text columns."""
    data = prepared(spark, sf)
    filled = materialize(filled_requests(spark, sf, data), "requests")
    means = eda.mean_values(split_of(data, "train"), LEAN.features)
    phi = explain.linear_attributions(filled, ID, fixed_scores.RISK, means)
    factors = explain.top_factors(phi, ID, REPORT_FACTORS)
    profile = ("total_cents", "acctbal_cents", "c_nationkey")
    keep = filled.select(*[F.col(c).cast("bigint").alias(c) if c in profile else F.col(c) for c in filled.columns])
    records = services.report_records(fixed_scores.score_risk(keep), factors, ID, profile, REPORT_TIME)
    entry = F.transform("profile", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    line = F.transform(
        "factors",
        lambda f: F.format_string("%s %s (magnitude: %.4f)", f["feature"], f["effect"], f["magnitude"]),
    )
    return records.select(
        ID,
        F.array_join(entry, "; ").alias("profile"),
        "risk_score",
        "level",
        "recommendation",
        F.array_join(line, "; ").alias("factors"),
        "generated_at",
    )


def stream_scoring(spark, sf):
    """Orders read as a stream, joined with their lines and customers, scored and appended to a table."""
    data = prepared(spark, sf)
    schema = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_custkey", T.LongType()),
            T.StructField("o_totalprice", T.DoubleType()),
            T.StructField("o_orderpriority", T.StringType()),
        ]
    )
    arriving = scoring.read_requests_stream(spark, sf, schema, "orders.parquet")
    rows = cohorts.order_requests(spark, sf, arriving)
    rows = prep.encode_labels(rows, LEAN.categorical, read_table(spark, sf, "orders"))
    out = scoring.score_stream(rows, test_means(data), fixed_scores.score_risk, TUNED_THRESHOLD)
    path = scoring.run_to_table(out.select(ID, "n_filled", "p", "assessment.level", "decision"))
    return spark.read.parquet(path)


# --- trained models ------------------------------------------------------------------------


def _all_models():
    return models.refined_models() | models.OTHER_MODELS


def _trained(name: str):
    def query(spark, sf):
        experiment = ex.REFINED_EXPERIMENTS[1:2]
        run = ex.run_experiments(cohort(spark, sf), ORDERS, experiment, registry=_all_models, only=(name,))
        return run.complete().predictions

    return query


def _refined_predictions(spark, sf):
    key = hashlib.md5(sf.encode()).hexdigest()[:12]
    return RunCache(spark).get(
        "refined", lambda: ex.run_experiments(cohort(spark, sf), ORDERS).complete().predictions, data=key, cv=False
    )


def _refined_board(spark, sf):
    table = _refined_predictions(spark, sf)
    auc = curves.roc_auc(curves.score_counts_by_value(table), metrics.DIGITS)
    return metrics.leaderboard(table, auc)


def experiments(spark, sf):
    """All models in all three experiments, as one leaderboard; an error if any of them could not be trained."""
    return _refined_board(spark, sf)


def smote_comparison(spark, sf):
    names = ("balanced_accuracy", "macro_f1", "macro_recall")
    return metrics.side_by_side(
        _refined_board(spark, sf), "no_leakage", "no_leakage_no_smote", names, top=5
    )


def cross_validation(spark, sf):
    """Logistic regression refitted per fold, with rebalancing inside the folds."""
    train = split_of(prepared(spark, sf), "train")
    name = "Logistic Regression"
    fit = models.refined_models()[name]
    rows = ex.cross_validate(train, LEAN, name, fit, ex.REFINED_EXPERIMENTS[1])
    return metrics.fold_scores(rows)


def stability(spark, sf):
    scores = ex.stability_check(prepared(spark, sf), LEAN)
    return metrics.stability_summary(scores)


def forest_importance(spark, sf):
    data = prepared(spark, sf)
    train = ex.training_table(split_of(data, "train"), LEAN, balance.FULL_RATIO, sampling.DEFAULT_SEED)
    return models.forest_importances(train, context(data, LEAN)).limit(15)


def tree_shap(spark, sf):
    """Exact attributions of the random forest for the test rows."""
    data = prepared(spark, sf)
    ctx = context(data, LEAN)
    train = ex.training_table(split_of(data, "train"), LEAN, balance.PARTIAL_RATIO, ctx.seed)
    fitted = models.refined_models()["Random Forest"](train, ctx)
    table, base = explain.tree_attributions(split_of(data, "test"), ID, LEAN.features, fitted.model.stages[-1])
    return table.withColumn("base_value", F.lit(base))


def permutation_shap(spark, sf):
    """Sampled attributions of the kernel SVM, for which no closed form exists."""
    data = prepared(spark, sf)
    ctx = context(data, LEAN)
    train = ex.training_table(split_of(data, "train"), LEAN, balance.PARTIAL_RATIO, ctx.seed)
    fitted = models.refined_models()["SVM"](train, ctx)
    test = split_of(data, "test")
    return explain.permutation_attributions(test, ID, LEAN.features, test, fitted.score, in_tasks=fitted.in_tasks())


def kernel_shap(spark, sf):
    """Kernel SHAP of the fixed pricing model, whose three features allow every coalition: exact Shapley values."""
    data = prepared(spark, sf)
    intercept, weights = fixed_scores.LINEAR[("no_leakage", "pricing")]

    def score(df):
        return df.withColumn("p", logistic(linear_score(intercept, weights)))

    test = split_of(data, "test")
    table = kernel_attributions(test, ID, weights, test, score)
    return table.select(ID, "feature", "value", F.round("phi", 6).alias("phi"), F.round("base_value", 6).alias("base_value"))


def kernel_shap_svm(spark, sf):
    """Kernel SHAP of the kernel SVM for the test rows."""
    data = prepared(spark, sf)
    ctx = context(data, LEAN)
    train = ex.training_table(split_of(data, "train"), LEAN, balance.PARTIAL_RATIO, ctx.seed)
    fitted = models.refined_models()["SVM"](train, ctx)
    test = split_of(data, "test")
    return kernel_attributions(
        test, ID, LEAN.features, test, fitted.score, SVM_COALITIONS, SVM_BACKGROUND, in_tasks=fitted.in_tasks()
    )


SQL_CHECKED = (
    audit_profile,
    null_counts,
    class_distribution,
    category_distribution,
    prevalence,
    majority_baseline,
    leakage_screen,
    document_screen,
    drop_leakage,
    hist_by_class,
    hist_shared,
    variance_top20,
    corr_lower,
    box_stats,
    feature_direction,
    column_means,
    stratified_sample,
    stratified_split,
    stratified_folds,
    repeated_splits,
    train_test_union,
    label_encode,
    standard_scale,
    class_weights,
    smote_neighbors,
    smote_resample,
    smote_full_balance,
    confusion_counts,
    leaderboard,
    board_view,
    headline,
    best_model,
    leakage_drop,
    experiment_comparison,
    metrics_long,
    accuracy_axis,
    classification_report,
    cv_scores,
    cv_accuracy,
    roc_auc,
    roc_curve,
    roc_curve_compact,
    pr_curve,
    average_precision,
    threshold_tuning,
    best_threshold,
    metrics_at_threshold,
    calibration,
    risk_histogram,
    error_rows,
    error_patterns,
    shuffled_sanity,
    knn_vote,
    vector_neighbors,
    random_tree_cuts,
    svm_residuals,
    gaussian_nb,
    linear_shap,
    kernel_shap,
    shap_global,
    shap_grouped,
    shap_topn,
    shap_protective_risk,
    shap_waterfall,
    shap_beeswarm,
    request_fill,
    request_flags,
    request_validation,
    risk_tier,
    counterfactual,
    risk_percentile,
    similar_subjects,
    similar_outcomes,
    risk_report,
    stream_scoring,
)

TRAINED_MODELS = {
    "train_logistic": "Logistic Regression",
    "train_tree": "Decision Tree",
    "train_forest": "Random Forest",
    "train_gbt": "Gradient Boosting",
    "train_kernel_svm": "SVM",
    "train_rff_svm": "SVM on Fourier features",
    "train_knn": "KNN",
    "train_naive_bayes": "Naive Bayes",
    "train_extra_trees": "Extra Trees",
    "train_gbt_pos_weighted": "Boosted Trees (positive weight)",
    "train_gbt_balanced": "Boosted Trees (balanced)",
}

ROWS_ONLY = (
    experiments,
    smote_comparison,
    cross_validation,
    stability,
    forest_importance,
    tree_shap,
    permutation_shap,
    kernel_shap_svm,
)


def _ready(query):
    """The query, with the package made available to the Python workers first."""

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf)

    return run


def all_queries() -> dict:
    named = {q.__name__: q for q in SQL_CHECKED}
    named.update({key: _trained(model) for key, model in TRAINED_MODELS.items()})
    named.update({q.__name__: q for q in ROWS_ONLY})
    return {name: _ready(query) for name, query in named.items()}

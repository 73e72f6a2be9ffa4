"""The full run: prepare, split, rebalance, train every model, score the test rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.ordering import hash_rank
from cohortlab.operators import balance, curves, metrics, models, prep, sampling
from cohortlab.session import discard, materialize, scratch_path
from cohortlab.spec import CohortSpec

PREDICTIONS_SCHEMA = "experiment string, model string, row_id bigint, y int, p double, yhat int"
STATUS_SCHEMA = "experiment string, model string, status string, error string, seconds double"


@dataclass(frozen=True)
class Experiment:
    """One combination of feature set and rebalancing."""

    name: str
    leakage: bool
    smote_ratio: float | None


# The experiments of the two kinds of run.
REFINED_EXPERIMENTS = (
    Experiment("full", True, balance.PARTIAL_RATIO),
    Experiment("no_leakage", False, balance.PARTIAL_RATIO),
    Experiment("no_leakage_no_smote", False, None),
)
RESEARCH_EXPERIMENTS = (
    Experiment("full", True, balance.FULL_RATIO),
    Experiment("no_leakage", False, balance.FULL_RATIO),
)


@dataclass
class Run:
    """Everything an experiment run leaves behind."""

    spec: CohortSpec
    prepared: DataFrame
    predictions: DataFrame
    status: DataFrame
    trained: dict = field(default_factory=dict)
    cv: DataFrame | None = None
    outcomes: dict = field(default_factory=dict)  # every training by experiment and model, failed ones too

    def complete(self) -> Run:
        """This run if all its models were trained, otherwise an error that names those that were not."""
        models.require_trained({f"{model} ({experiment})": t for (experiment, model), t in self.outcomes.items()})
        return self

    def subject_predictions(self) -> DataFrame:
        """The predictions with the cohort's own ids as ``subject``, whatever their type."""
        given = given_id(self.spec)
        own = given if given in self.prepared.columns else self.spec.id_col
        ids = self.prepared.select(F.col(self.spec.id_col).alias("row_id"), F.col(own).alias("subject"))
        return self.predictions.join(ids, "row_id")

    def leaderboard(self, rank_by: str = "balanced_accuracy", cv_metric: str = "balanced_accuracy") -> DataFrame:
        """One row per trained model: metrics, ``cv_mean`` and ``cv_std`` over the folds, ``train_seconds``.

        Without cross-validation the two are null.
        """
        auc = curves.roc_auc(curves.score_counts_by_value(self.predictions), metrics.DIGITS)
        board = metrics.leaderboard(self.predictions, auc, rank_by)
        seconds = self.status.select("experiment", "model", F.round("seconds", 2).alias("train_seconds"))
        if self.cv is None:
            none = F.lit(None).cast("double")
            board = board.withColumns({"cv_mean": none, "cv_std": none})
        else:
            folds = metrics.fold_scores(self.cv, cv_metric)
            folds = folds.select("experiment", "model", F.col("mean_score").alias("cv_mean"), F.col("std_score").alias("cv_std"))
            board = board.join(folds, ["experiment", "model"], "left")
        return board.join(seconds, ["experiment", "model"], "left").orderBy("experiment", "position")

    def best(self, experiment: str, rank_by: str = "balanced_accuracy") -> BestModel:
        """The first model of the experiment with the threshold that suits its test predictions best."""
        board = metrics.best_model(metrics.leaderboard(self.predictions, rank_by=rank_by))
        first = board.where(F.col("experiment") == experiment).first()
        if first is None:
            raise ValueError(f"no model of experiment {experiment!r} was trained")
        own = self.predictions.where((F.col("experiment") == experiment) & (F.col("model") == first["model"]))
        tuned = metrics.best_threshold(metrics.threshold_table(own)).first()
        return BestModel(first["model"], self.trained[experiment, first["model"]], tuned["threshold"])


@dataclass
class BestModel:
    """A trained model and the probability from which on its threshold calls a subject positive."""

    name: str
    fitted: models.Fitted
    threshold: float

    def assess(self, requests: DataFrame) -> DataFrame:
        """``requests``, which hold the model's features, with ``p`` and ``flagged``."""
        scored = self.fitted.score(requests).drop("yhat")
        return scored.withColumn("flagged", (F.col("p") >= self.threshold).cast("int"))


def given_id(spec: CohortSpec) -> str:
    """Column of a prepared cohort with the ids as given, where they are no whole numbers."""
    return f"{spec.id_col}_given"


def prepare(
    cohort: DataFrame, spec: CohortSpec, sample_n: int | None = None, seed: int = sampling.DEFAULT_SEED
) -> DataFrame:
    """Encoded cohort with a ``split`` column, written once for all later jobs.

    The sample is optional: without ``sample_n`` the run uses every row.  Ids that are
    no whole numbers give way to their rank in hash order and stay in ``given_id``.
    """
    base = cohort.drop(*spec.drop)
    if sample_n is not None:
        base = sampling.stratified_sample(base, spec, sample_n, seed)
    base = written = materialize(base, "cohort")
    encoded = prep.encode_labels(base, spec.categorical)
    split = sampling.stratified_split(encoded, spec, seed=seed)
    if not isinstance(cohort.schema[spec.id_col].dataType, T.IntegralType):
        ranked = hash_rank(split, spec.id_col, seed, rank_col="_number")
        named = ranked.withColumnRenamed(spec.id_col, given_id(spec))
        split = named.withColumnRenamed("_number", spec.id_col)
    done = materialize(split, "prepared")
    discard(written)
    return done


def training_table(train: DataFrame, spec: CohortSpec, ratio: float | None, seed: int) -> DataFrame:
    """Training rows with id, target and features, rebalanced if a ratio is given."""
    if ratio is None:
        return train.select(spec.id_col, spec.target, *spec.features)
    n_neg, n_pos = prep.class_counts(train, spec.target)
    if min(n_neg, n_pos) >= ratio * max(n_neg, n_pos):
        raise ValueError(f"classes {n_neg}/{n_pos} already exceed ratio {ratio}")
    table = balance.smote(train, spec.id_col, spec.target, spec.features, ratio, seed=seed)
    return materialize(table.select(spec.id_col, spec.target, *spec.features), "train")


def run_experiments(
    cohort: DataFrame,
    spec: CohortSpec,
    experiments=REFINED_EXPERIMENTS,
    registry: Callable[[], dict] = models.refined_models,
    only=None,
    sample_n: int | None = None,
    use_cv: bool = False,
    parallelism: int = 12,
    seed: int = sampling.DEFAULT_SEED,
) -> Run:
    """Train all models in all experiments; each model is one concurrent chain of Spark jobs.

    A model that cannot be trained is missing from the predictions and named in ``status``;
    ``complete()`` of the run raises an error then.
    """
    spark = cohort.sparkSession
    prepared = prepare(cohort, spec, sample_n, seed)
    train, test = prepared.where(F.col("split") == "train"), prepared.where(F.col("split") == "test")
    n_neg, n_pos = prep.class_counts(train, spec.target)
    out_root = scratch_path(spark, "predictions")
    specs = {e.name: spec if e.leakage else spec.without_leakage() for e in experiments}

    def table_of(experiment: Experiment) -> DataFrame | Exception:
        try:
            return training_table(train, specs[experiment.name], experiment.smote_ratio, seed)
        except Exception as e:  # noqa: BLE001 - recorded for each model of this experiment only
            return e

    with ThreadPoolExecutor(max(1, len(experiments))) as pool:
        tables = list(pool.map(inheritable_thread_target(spark)(table_of), experiments))
    work = [
        (experiment, specs[experiment.name], table, name, fit)
        for experiment, table in zip(experiments, tables)
        for name, fit in registry().items()
        if only is None or name in only
    ]
    # Boosting is a long chain of short jobs: those chains start first.
    work.sort(key=lambda w: w[3] not in models.BOOSTED)

    def one(i: int):
        experiment, exp_spec, table, name, fit = work[i]
        ctx = models.Context(spec.id_col, spec.target, list(exp_spec.features), seed, n_neg, n_pos)

        folds = []

        def fit_and_score(data: DataFrame | Exception, ctx: models.Context) -> models.Fitted:
            if isinstance(data, Exception):
                raise data
            fitted = fit(data, ctx)
            rows = models.predictions_of(fitted, test, ctx, experiment.name, name)
            rows.write.mode("overwrite").parquet(f"{out_root}/part={i}")
            if use_cv:
                folds.append(cross_validate(train, exp_spec, name, fit, experiment, seed=seed))
            return fitted

        result = models.train_safely(name, fit_and_score, table, ctx)
        return experiment.name, result, folds[0] if folds else None

    with ThreadPoolExecutor(parallelism) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), range(len(work))))
    paths = [f"{out_root}/part={i}" for i, (_, r, _) in enumerate(done) if r.error is None]
    if paths:
        predictions = spark.read.schema(PREDICTIONS_SCHEMA).parquet(*paths)
    else:
        predictions = spark.createDataFrame([], PREDICTIONS_SCHEMA)
    status = spark.createDataFrame(
        [(e, r.name, r.status, r.error, float(r.seconds)) for e, r, _ in done], STATUS_SCHEMA
    )
    trained = {(e, r.name): r.fitted for e, r, _ in done if r.fitted is not None}
    fold_tables = [f for _, _, f in done if f is not None]
    cv = reduce(DataFrame.unionByName, fold_tables) if fold_tables else None
    outcomes = {(e, r.name): r for e, r, _ in done}
    return Run(spec, prepared, predictions, status, trained, cv, outcomes)


def cross_validate(
    train: DataFrame,
    spec: CohortSpec,
    name: str,
    fit,
    experiment: Experiment,
    folds: int = sampling.DEFAULT_FOLDS,
    seed: int = sampling.DEFAULT_SEED,
) -> DataFrame:
    """Out-of-fold predictions with a ``fold`` column; rebalancing happens inside each fold."""
    folded = materialize(sampling.stratified_folds(train, spec, folds, seed), "folds")
    parts = []
    for k in range(folds):
        fold_train = folded.where(F.col("fold") != k)
        n_neg, n_pos = prep.class_counts(fold_train, spec.target)
        ctx = models.Context(spec.id_col, spec.target, list(spec.features), seed, n_neg, n_pos)
        table = training_table(fold_train, spec, experiment.smote_ratio, seed)
        fitted = fit(table, ctx)
        held_out = folded.where(F.col("fold") == k)
        rows = models.predictions_of(fitted, held_out, ctx, experiment.name, name)
        parts.append(rows.withColumn("fold", F.lit(k)))
    return materialize(reduce(DataFrame.unionByName, parts), "oof")


def stability_check(
    prepared: DataFrame,
    spec: CohortSpec,
    runs: int = 5,
    name: str = "Logistic Regression",
    registry: Callable[[], dict] = models.refined_models,
    smote_ratio: float | None = balance.PARTIAL_RATIO,
    seed: int = sampling.DEFAULT_SEED,
) -> DataFrame:
    """Balanced accuracy of one model refitted on several random splits."""
    fit = registry()[name]
    rows = prepared.drop("split")
    parts = []
    for run in range(runs):
        split = materialize(sampling.stratified_split(rows, spec, seed=seed + run), "stability")
        train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
        n_neg, n_pos = prep.class_counts(train, spec.target)
        ctx = models.Context(spec.id_col, spec.target, list(spec.features), seed, n_neg, n_pos)
        fitted = fit(training_table(train, spec, smote_ratio, seed), ctx)
        scored = models.predictions_of(fitted, test, ctx, f"run_{run}", name)
        parts.append(scored)
    counts = metrics.confusion_counts(reduce(DataFrame.unionByName, parts))
    scored = counts.withColumn("score", metrics.metric_columns()["balanced_accuracy"])
    return scored.select(F.col("experiment").alias("run"), "model", "score")

"""Experiment runs on small cohorts: ids of any type, failures kept to their model."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.operators import models
from cohortlab.plans import catalog
from cohortlab.plans.experiments import Experiment, run_experiments
from cohortlab.spec import PATIENT_SCHEMA, PATIENTS


def patients(spark, n, negatives):
    """``n`` patients with ids like P204, of whom every ``negatives``-th is healthy."""

    def value(f):
        if f.name == "PatientID":
            return F.concat(F.lit("P"), F.col("id").cast("string"))
        if f.name == "Diagnosis":
            return (F.col("id") % negatives != 0).cast("int")
        draw = F.pmod(F.xxhash64("id", F.lit(f.name)), F.lit(1000))
        if isinstance(f.dataType, T.StringType):
            return F.when(draw < 500, "Low").otherwise("High")
        return (draw / 10 if isinstance(f.dataType, T.DoubleType) else draw % 5).cast(f.dataType)

    return spark.range(n).select(*(value(f).alias(f.name) for f in PATIENT_SCHEMA.fields))


@pytest.fixture(scope="module")
def run(spark):
    return run_experiments(patients(spark, 300, 6), PATIENTS, only={"Naive Bayes", "KNN"})


def test_string_ids_run_through_all_experiments(run):
    status = {(r["experiment"], r["model"]): r["error"] for r in run.status.collect()}
    assert len(status) == 6 and set(status.values()) == {None}


def test_predictions_carry_the_given_ids(run):
    rows = run.subject_predictions().collect()
    assert len(rows) == run.predictions.count() == 6 * 60
    ids = {(r["subject"], r["row_id"]) for r in rows}
    assert len(ids) == 60 and all(s.startswith("P") for s, _ in ids)
    assert all(r["y"] == (int(r["subject"][1:]) % 6 != 0) for r in rows)


def test_refused_rebalancing_ends_only_its_experiment(spark):
    experiments = (Experiment("rebalanced", False, 0.5), Experiment("plain", False, None))
    done = run_experiments(patients(spark, 100, 2), PATIENTS, experiments, only={"Naive Bayes"})
    status = {r["experiment"]: r["status"] for r in done.status.collect()}
    assert status == {"rebalanced": "failed", "plain": "ok"}
    assert {r["experiment"] for r in done.predictions.select("experiment").distinct().collect()} == {"plain"}


def test_cross_validation_failure_is_recorded(spark):
    calls = []

    def fit(train, ctx):
        calls.append(1)
        if len(calls) > 1:
            raise ValueError("a fold cannot be fitted")
        return models.GaussianBayes.fit(train, ctx.target, ctx.features)

    experiments = (Experiment("plain", False, None),)
    done = run_experiments(patients(spark, 100, 3), PATIENTS, experiments, lambda: {"m": fit}, use_cv=True)
    row = done.status.first()
    assert (row["status"], row["error"]) == ("failed", "a fold cannot be fitted") and done.cv is None


def test_queries_on_all_models_raise_for_a_failed_one(spark, tmp_path, monkeypatch):
    def broken(train, ctx):
        raise ValueError("cannot train")

    registry = {"broken": broken, "Naive Bayes": models.refined_models()["Naive Bayes"]}
    rows = spark.range(400).selectExpr(
        "id row_id", "cast(id % 7 = 0 as int) target", "'1-URGENT' o_orderpriority", *(f"xxhash64(id, '{f}') % 100 {f}" for f in catalog.ORDERS.features if f != "o_orderpriority")
    )
    monkeypatch.setattr(catalog, "cohort", lambda spark, sf: rows)
    monkeypatch.setattr(catalog.ex.run_experiments, "__defaults__", (catalog.ex.REFINED_EXPERIMENTS, lambda: registry, *catalog.ex.run_experiments.__defaults__[2:]))
    for query in (catalog.experiments, catalog.smote_comparison):  # the second finds no table kept by the first
        with pytest.raises(RuntimeError, match="3 of 6 trainings failed: broken .full.: cannot train; broken .no_leakage.: ") as raised:
            query(spark, str(tmp_path))
        assert isinstance(raised.value.__cause__, ValueError)
    del registry["broken"]
    assert catalog.experiments(spark, str(tmp_path)).count() == 3


def test_leaderboard_has_training_time_and_no_folds(run):
    board = run.leaderboard().collect()
    seconds = {(r["experiment"], r["model"]): r["seconds"] for r in run.status.collect()}
    assert len(board) == 6
    for r in board:
        assert r["train_seconds"] == pytest.approx(seconds[r["experiment"], r["model"]], abs=0.006)
        assert r["cv_mean"] is None and r["cv_std"] is None


def test_leaderboard_has_mean_and_deviation_over_folds(spark):
    def fit(train, ctx):
        return models.GaussianBayes.fit(train, ctx.target, ctx.features)

    experiments = (Experiment("plain", False, None),)
    done = run_experiments(patients(spark, 200, 3), PATIENTS, experiments, lambda: {"m": fit}, use_cv=True)
    r = done.leaderboard(cv_metric="accuracy").first()
    right = {}
    for row in done.cv.collect():
        right.setdefault(row["fold"], []).append(row["y"] == row["yhat"])
    shares = [sum(v) / len(v) for v in right.values()]
    mean = sum(shares) / 5
    assert len(shares) == 5 and r["cv_mean"] == pytest.approx(mean, abs=1e-4)
    assert r["cv_std"] == pytest.approx((sum((x - mean) ** 2 for x in shares) / 5) ** 0.5, abs=1e-4)


def test_best_model_flags_by_its_tuned_threshold(run):
    best = run.best("no_leakage_no_smote")
    board = [r for r in run.leaderboard().collect() if r["experiment"] == "no_leakage_no_smote"]
    assert best.name == max(board, key=lambda r: (r["balanced_accuracy"], [-ord(c) for c in r["model"]]))["model"]
    own = [r for r in run.predictions.collect() if r["experiment"] == "no_leakage_no_smote" and r["model"] == best.name]

    def macro_f1(t):
        said = [(r["p"] >= t, r["y"] == 1) for r in own]

        def f1(c):
            hit = sum(a == b == c for a, b in said)
            return 2 * hit / (sum(a == c for a, _ in said) + sum(b == c for _, b in said))

        return (f1(False) + f1(True)) / 2

    assert macro_f1(best.threshold) == pytest.approx(max(macro_f1(i / 20) for i in range(1, 19)), abs=1e-4)
    test = run.prepared.where("split = 'test'")
    flags = {r["PatientID"]: (r["p"], r["flagged"]) for r in best.assess(test).collect()}
    assert len(flags) == 60 and all(f == int(p >= best.threshold) for p, f in flags.values())
    with pytest.raises(ValueError, match="no model"):
        run.best("absent")


def test_research_svm_has_no_class_weights():
    assert models.research_models()["SVM"].keywords == {"weights": None}

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import curves, metrics, models
from cohortlab.plans import catalog
from cohortlab.plans import experiments as ex
from cohortlab.sources.cohorts import ORDERS

QUICK = ("Logistic Regression", "Decision Tree", "KNN")


@pytest.fixture(scope="module")
def run(spark, small):
    return ex.run_experiments(catalog.cohort(spark, small), ORDERS, only=QUICK)


def test_run_covers_models_and_experiments(run):
    n_test = run.prepared.where("split = 'test'").count()
    counts = run.predictions.groupBy("experiment", "model").count().collect()
    assert len(counts) == 9 and {r["count"] for r in counts} == {n_test}
    assert {r["status"] for r in run.status.collect()} == {"ok"}


def test_probabilities_and_no_synthetic_rows(run):
    bad = run.predictions.where("p < 0 or p > 1 or p is null or row_id < 0 or yhat not in (0, 1)")
    assert bad.count() == 0


def test_models_beat_chance_and_leakage_helps(run):
    board = {(r["experiment"], r["model"]): r for r in run.leaderboard().collect()}
    for (_, _), row in board.items():
        assert row["roc_auc"] > 0.7
    name = "Logistic Regression"
    assert board[("full", name)]["roc_auc"] > board[("no_leakage", name)]["roc_auc"]


def test_leaderboard_is_sorted(run):
    for experiment in ("full", "no_leakage"):
        rows = run.leaderboard().where(F.col("experiment") == experiment).orderBy("position").collect()
        scores = [r["balanced_accuracy"] for r in rows]
        assert scores == sorted(scores, reverse=True)


def test_failed_model_does_not_end_the_run(spark, small):
    def registry():
        def broken(train, ctx):
            raise RuntimeError("cannot train")

        return {"broken": broken, "Naive Bayes": models.refined_models()["Naive Bayes"]}

    run = ex.run_experiments(
        catalog.cohort(spark, small), ORDERS, ex.REFINED_EXPERIMENTS[2:], registry=registry, sample_n=600
    )
    status = {r["model"]: (r["status"], r["error"]) for r in run.status.collect()}
    assert status["broken"] == ("failed", "cannot train")
    assert status["Naive Bayes"][0] == "ok"
    assert [r["model"] for r in run.predictions.select("model").distinct().collect()] == ["Naive Bayes"]
    assert run.prepared.count() == 600


def test_research_run_with_cross_validation(spark, small):
    run = ex.run_experiments(
        catalog.cohort(spark, small),
        ORDERS,
        ex.RESEARCH_EXPERIMENTS[1:],
        registry=models.research_models,
        only=("Naive Bayes",),
        use_cv=True,
    )
    folds = metrics.fold_scores(run.cv, "accuracy").first()
    assert folds["n_folds"] == 5 and 0.5 < folds["mean_score"] <= 1.0
    train = run.prepared.where("split = 'train'")
    assert run.cv.count() == train.count()
    assert run.leaderboard("accuracy").count() == 1


@pytest.mark.parametrize("name", ["SVM", "Extra Trees", "Gradient Boosting", "Boosted Trees (positive weight)"])
def test_other_models_learn(prepared, name, monkeypatch):
    monkeypatch.setattr(models, "BOOST_ROUNDS", 5)
    monkeypatch.setattr(models, "FOREST_TREES", 8)
    ctx = catalog.context(prepared, catalog.LEAN)
    train, test = (catalog.split_of(prepared, s) for s in ("train", "test"))
    fit = {
        "Gradient Boosting": models._pipeline_fit(models._boosting(3, 0.1, 0.8), False, None),
        "Boosted Trees (positive weight)": models._pipeline_fit(
            models._boosting(3, 0.3, 1.0), False, "positive"
        ),
    }.get(name, models.refined_models()[name])
    table = models.predictions_of(fit(train, ctx), test, ctx, "e", name)
    assert table.where("p < 0 or p > 1").count() == 0
    assert curves.roc_auc(curves.score_counts_by_value(table)).first()["roc_auc"] > 0.7


def test_pipeline_round_trip(prepared, tmp_path):
    ctx = catalog.context(prepared, catalog.LEAN)
    train, test = (catalog.split_of(prepared, s) for s in ("train", "test"))
    fitted = models.refined_models()["Logistic Regression"](train, ctx)
    fitted.save(str(tmp_path / "m"))
    again = models.FittedPipeline.load(str(tmp_path / "m"))
    a = {r["row_id"]: r["p"] for r in fitted.score(test).collect()}
    b = {r["row_id"]: r["p"] for r in again.score(test).collect()}
    assert a == b


def test_gaussian_bayes_equals_spark(prepared):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler

    cols = ["n_lines", "qty", "disc_pts"]
    train, test = (catalog.split_of(prepared, s) for s in ("train", "test"))
    mine = models.GaussianBayes.fit(train, "target", cols).score(test)
    vec = VectorAssembler(inputCols=cols, outputCol="v")
    theirs = NaiveBayes(modelType="gaussian", featuresCol="v", labelCol="target").fit(vec.transform(train))
    joined = theirs.transform(vec.transform(mine.drop("prediction")))
    from pyspark.ml.functions import vector_to_array

    gap = joined.agg(F.max(F.abs(vector_to_array("probability")[1] - F.col("p")))).first()[0]
    assert gap < 1e-4


def test_forest_importances_sum_to_one(prepared):
    ctx = catalog.context(prepared, catalog.LEAN)
    table = models.forest_importances(catalog.split_of(prepared, "train"), ctx, trees=5).collect()
    values = [r["importance"] for r in table]
    assert sum(values) == pytest.approx(1.0) and values == sorted(values, reverse=True)

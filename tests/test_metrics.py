import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlab.operators import curves, metrics
from conftest import predictions


def scores(spark, rows):
    return metrics.score_counts(metrics.confusion_counts(predictions(spark, rows))).first()


def auc_of(spark, rows):
    return curves.roc_auc(curves.score_counts_by_value(predictions(spark, rows))).first()["roc_auc"]


TIES = [(1, 0.9, 1), (0, 0.9, 1), (1, 0.8, 1), (1, 0.6, 1), (0, 0.6, 1),
        (0, 0.4, 0), (1, 0.4, 0), (0, 0.2, 0), (0, 0.2, 0), (1, 0.1, 0)]


def test_auc_gives_ties_half_credit(spark):
    pos = [p for y, p, _ in TIES if y == 1]
    neg = [p for y, p, _ in TIES if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert auc_of(spark, TIES) == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-6)


def test_auc_complement_and_single_class(spark):
    flipped = [(y, 1 - p, h) for y, p, h in TIES]
    assert auc_of(spark, TIES) + auc_of(spark, flipped) == pytest.approx(1.0, abs=2e-6)
    assert auc_of(spark, [(1, 0.2, 0), (1, 0.7, 1)]) is None


def test_auc_equals_spark_evaluator(spark, prepared):
    from cohortlab.plans import fixed_scores

    table = fixed_scores.predictions(prepared, "row_id", "target")
    one = table.where("experiment = 'no_leakage' and model = 'coarse'")
    mine = curves.roc_auc(curves.score_counts_by_value(one)).first()["roc_auc"]
    raw = one.withColumn("raw", array_to_vector(F.array(1 - F.col("p"), F.col("p"))))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0).evaluate(raw)
    assert mine == pytest.approx(theirs, abs=1e-6)


def test_crowded_scores_do_not_change_the_area(spark):
    rows = [(i % 3 == 0, 1e-4 + i * 1e-7, 0) for i in range(900)] + [(1, 0.9, 1), (0, 0.8, 1)]
    rows = [(int(y), p, h) for y, p, h in rows]
    pos = [p for y, p, _ in rows if y == 1]
    neg = [p for y, p, _ in rows if y == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc_of(spark, rows) == pytest.approx(want, abs=1e-6)


def test_roc_and_pr_points(spark):
    table = curves.score_counts_by_value(predictions(spark, TIES))
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in curves.roc_curve(table).collect()}
    assert roc[None] == (0.0, 0.0)
    assert roc[0.9] == (0.2, 0.2)
    assert roc[0.1] == (1.0, 1.0)
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in curves.pr_curve(table).collect()}
    assert pr[None] == (1.0, 0.0)
    assert pr[0.6] == (0.6, 0.6)


def test_compact_roc_drops_points_on_a_line(spark):
    rows = [(1, 0.9, 1), (1, 0.8, 1), (1, 0.7, 1), (0, 0.6, 1), (0, 0.5, 1)]
    table = curves.score_counts_by_value(predictions(spark, rows))
    kept = {r["threshold"] for r in curves.roc_curve(table, drop_collinear=True).collect()}
    assert kept == {None, 0.7, 0.5}


def test_one_class_balanced_accuracy_uses_present_classes(spark):
    r = scores(spark, [(1, 0.9, 1)] * 4 + [(1, 0.2, 0)] * 2)
    assert r["balanced_accuracy"] == pytest.approx(0.6667)


def test_never_positive_has_zero_not_error(spark):
    r = scores(spark, [(1, 0.1, 0)] * 3 + [(0, 0.1, 0)] * 5)
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert r["macro_f1"] == pytest.approx(round((10 / 13) / 2, 4))


def test_perfect(spark):
    rows = [(1, 0.9, 1)] * 4 + [(0, 0.1, 0)] * 4
    r = scores(spark, rows)
    assert r["cohen_kappa"] == 1.0 and r["accuracy"] == 1.0
    table = curves.score_counts_by_value(predictions(spark, rows))
    assert curves.average_precision(table).first()["average_precision"] == 1.0


def test_kappa_is_null_without_disagreement_by_chance(spark):
    assert scores(spark, [(1, 0.9, 1)] * 4)["cohen_kappa"] is None


def test_calibration_edges_belong_to_the_lower_bin(spark):
    rows = [(0, 0.0, 0), (0, 0.1, 0), (1, 0.2, 0), (1, 1.0, 1)]
    got = {r["bin"]: r["n"] for r in curves.calibration_curve(predictions(spark, rows)).collect()}
    assert got == {1: 2, 2: 1, 10: 1}


def test_histogram_last_bin_holds_one(spark):
    got = curves.risk_histogram(predictions(spark, [(1, 1.0, 1), (0, 0.0, 0)])).collect()
    assert {r["bin"] for r in got} == {0, 29}


def test_threshold_table_equals_direct_evaluation(spark):
    table = {r["threshold"]: r for r in metrics.threshold_table(predictions(spark, TIES)).collect()}
    assert len(table) == 18
    for th, row in table.items():
        direct = scores(spark, [(y, p, int(p >= th)) for y, p, _ in TIES]) if th in (0.05, 0.4, 0.9) else None
        if direct is not None:
            assert row["macro_f1"] == direct["macro_f1"]
            assert row["balanced_accuracy"] == direct["balanced_accuracy"]


def test_first_of_equal_thresholds_wins(spark):
    best = metrics.best_threshold(metrics.threshold_table(predictions(spark, [(1, 0.9, 1), (0, 0.12, 0)])))
    assert best.first()["threshold"] == 0.15


def test_shuffled_labels_keep_class_counts(spark):
    rows = [(int(i % 4 == 0), 0.5, int(i % 4 == 0)) for i in range(400)]
    got = metrics.shuffled_label_check(predictions(spark, rows)).first()[-1]
    assert 0.35 < got < 0.65


def test_percentile_is_strict(spark):
    population = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (0.9,)], "p double")
    asked = spark.createDataFrame([(1, 0.2), (2, 0.95), (3, 0.05)], "id int, p double")
    got = {r["id"]: r["percentile"] for r in curves.percentile_of(asked, population, "id").collect()}
    assert got == {1: 25.0, 2: 100.0, 3: 0.0}


def test_stability_summary(spark):
    df = spark.createDataFrame([("a", 0.8), ("a", 0.81), ("b", 0.5), ("b", 0.9)], "model string, score double")
    got = {r["model"]: r["stable"] for r in metrics.stability_summary(df).collect()}
    assert got == {"a": 1, "b": 0}


def test_shuffled_labels_are_sorted_by_as_many_tasks_as_the_rows_need(spark, monkeypatch):
    rows = [(i % 2, 0.5, i % 3 % 2) for i in range(90)]
    table = predictions(spark, rows)
    few = metrics.shuffled_label_check(table).collect()
    monkeypatch.setattr(metrics, "ROWS_PER_SORT", 2)
    many = metrics.shuffled_label_check(table)
    assert many.collect() == few
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 45), REPARTITION_BY_NUM") >= 4

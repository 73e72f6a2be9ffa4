import json

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import models, services
from cohortlab.plans import catalog
from cohortlab.sources import cohorts, tables
from cohortlab.spec import PATIENT_SCHEMA, PATIENT_SHIFTS
from cohortlab.streaming import scoring


def test_tier_edges(spark):
    df = spark.createDataFrame([(0.2999,), (0.3,), (0.6999,), (0.7,)], "p double")
    levels = [r["assessment"]["level"] for r in services.assess(df, 0.7).collect()]
    assert levels == ["Low Risk", "Moderate Risk", "Moderate Risk", "High Risk"]


def test_fill_counts_missing(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 3.0, None)], "id int, a double, b double")
    got = services.fill_missing(df, {"a": 10.0, "b": 20.0}).orderBy("id").collect()
    assert [(r["a"], r["b"], r["n_filled"]) for r in got] == [(10.0, 2.0, 1), (3.0, 20.0, 1)]


def test_counterfactual_skips_absent_features(spark):
    df = spark.createDataFrame([(1, 150.0, 30.0)], "id int, SystolicBP double, BMI double")

    def score(d):
        return d.withColumn("p", F.col("SystolicBP") / 1000 + F.col("BMI") / 100)

    rows = services.counterfactuals(df, "id", ["SystolicBP", "BMI"], PATIENT_SHIFTS, score).collect()
    got = {r["feature"]: r["risk_change_percent"] for r in rows}
    assert got == {"SystolicBP": -2.0, "BMI": -3.0}


def test_bounds_ignore_missing_values(spark):
    df = spark.createDataFrame([(1, None, 10), (2, 300.0, 95)], "id int, SystolicBP double, Age int")
    rows = services.bound_violations(df, "id", {"SystolicBP": (90, 200), "Age": (20, 90)}).collect()
    assert {(r["id"], r["feature"]) for r in rows} == {(1, "Age"), (2, "SystolicBP"), (2, "Age")}


def test_report_record(spark, tmp_path):
    scored = spark.createDataFrame([(1, 50, 0.81234)], "id int, Age int, p double")
    rows = [(1, "BMI", 0.25, 2), (1, "Age", -0.5, 1)]
    factors = spark.createDataFrame(rows, "id int, feature string, phi double, factor_rank int")
    record = services.report_records(scored, factors, "id", ["Age", "Absent"], "2024-05-06 07:08:09")
    r = record.first()
    assert (r["risk_score"], r["level"], r["generated_at"]) == ("81.2%", "HIGH RISK", "2024-05-06 07:08:09")
    assert [(f["feature"], f["effect"]) for f in r["factors"]] == [
        ("Age", "Reduces Risk"),
        ("BMI", "Increases Risk"),
    ]
    assert [(e["key"], e["value"]) for e in r["profile"]] == [("Age", "50")]
    tables.write_reports(record, str(tmp_path / "reports"))
    folder = tmp_path / "reports" / "level=HIGH RISK"
    folder = folder if folder.exists() else tmp_path / "reports" / "level=HIGH%20RISK"
    line = next(folder.glob("*.json")).read_text()
    assert json.loads(line)["risk_score"] == "81.2%"


def test_csv_round_trip_by_name(spark, tmp_path):
    df = spark.createDataFrame([("p1", 40, 0.5, 1)], "PatientID string, Age int, BMI double, Diagnosis int")
    tables.write_csv(df.select("Diagnosis", "BMI", "PatientID", "Age"), str(tmp_path / "c"))
    schema = type(PATIENT_SCHEMA)([f for f in PATIENT_SCHEMA.fields if f.name in df.columns])
    again = tables.read_cohort_csv(spark, str(tmp_path / "c"), schema)
    assert again.columns == ["PatientID", "Age", "BMI", "Diagnosis"]
    assert again.collect()[0] == ("p1", 40, 0.5, 1)
    with pytest.raises(ValueError, match="GFR"):
        tables.read_cohort_csv(spark, str(tmp_path / "c"), schema.add("GFR", "double"))


def test_csv_files_with_other_column_order_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Age,BMI\n40,22.5\n")
    (tmp_path / "b.csv").write_text("BMI,Age\n30.0,55\n")
    schema = type(PATIENT_SCHEMA)([f for f in PATIENT_SCHEMA.fields if f.name in ("Age", "BMI")])
    with pytest.raises(Exception, match="header"):
        tables.read_cohort_csv(spark, str(tmp_path), schema).collect()


def test_csv_with_bad_number_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Age\nforty\n")
    schema = type(PATIENT_SCHEMA)([f for f in PATIENT_SCHEMA.fields if f.name == "Age"])
    with pytest.raises(Exception):
        tables.read_cohort_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_run_cache_builds_once(spark, tmp_path):
    cache = tables.RunCache(spark, str(tmp_path))
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.get("r", build, sample_n=5000, use_cv=False).count() == 3
    assert cache.get("r", build, sample_n=100, use_cv=False).count() == 3
    assert len(built) == 2


def test_trained_pipeline_scores_a_stream(spark, small, prepared):
    """A fitted pipeline gives the same probabilities on a stream as on a table."""
    ctx = catalog.context(prepared, catalog.LEAN)
    fitted = models.refined_models()["Logistic Regression"](catalog.split_of(prepared, "train"), ctx)
    means = catalog.test_means(prepared)
    orders = tables.read_table(spark, small, "orders")
    stream = scoring.read_requests_stream(spark, small, orders.schema, "orders.parquet")

    def scored(source):
        rows = cohorts.order_requests(spark, small, source)
        rows = catalog.prep.encode_labels(rows, ["o_orderpriority"], orders)
        return scoring.score_stream(rows, means, fitted.score).select("row_id", "p")

    path = scoring.run_to_table(scored(stream))
    got = {r["row_id"]: r["p"] for r in spark.read.parquet(path).collect()}
    want = {r["row_id"]: r["p"] for r in scored(orders).collect()}
    assert len(got) == orders.count() and got == want


def test_micro_batches_reach_the_handler(spark, small):
    orders = tables.read_table(spark, small, "orders")
    stream = scoring.read_requests_stream(spark, small, orders.schema, "orders.parquet")
    seen = []
    scoring.run_batches(stream, lambda df, i: seen.append(df.count()))
    assert sum(seen) == orders.count()

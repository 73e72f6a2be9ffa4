import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.ordering import exact_quantiles, hash_rank, running_totals, value_counts
from cohortlab.operators import eda, prep, sampling
from cohortlab.spec import PATIENTS, CohortSpec

SPEC = CohortSpec(id_col="id", target="y", features=("x",))


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1000).select("id", (F.col("id") % 12 != 0).cast("int").alias("y"), F.rand(1).alias("x"))


def test_sample_has_exact_quota(spark, table):
    counts = dict(sampling.stratified_sample(table, SPEC, 250).groupBy("y").count().collect())
    assert counts == {0: 21, 1: 229}


def test_sample_larger_than_table_is_the_table(spark, table):
    assert sampling.stratified_sample(table, SPEC, 5000).count() == 1000


def test_split_is_complete_and_ceils_the_test_share(spark, table):
    split = sampling.stratified_split(table.limit(997), SPEC)
    counts = dict(split.groupBy("split").count().collect())
    assert counts == {"test": 200, "train": 797}
    assert split.select("id").distinct().count() == 997


def test_draws_ignore_partitioning(spark, table):
    one = sampling.stratified_split(table.repartition(2), SPEC).where("split = 'test'")
    two = sampling.stratified_split(table.repartition(16), SPEC).where("split = 'test'")
    assert {r["id"] for r in one.collect()} == {r["id"] for r in two.collect()}


def test_seeds_differ(spark, table):
    runs = sampling.repeated_splits(table, SPEC, runs=2).where("split = 'test'").collect()
    a, b = ({r["id"] for r in runs if r["run"] == k} for k in (0, 1))
    assert a != b and len(a) == len(b) == 200


def test_folds_are_even_within_classes(spark, table):
    counts = sampling.stratified_folds(table, SPEC).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_hash_rank_is_the_md5_order(spark):
    got = hash_rank(spark.range(300), "id", 7).collect()
    want = sorted(range(300), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == want


def test_running_totals_match_a_plain_sum(spark):
    rows = [("a", float(v), 1) for v in range(500)] + [("b", v / 1e6, 2) for v in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    for desc in (False, True):
        got = running_totals(df, ["k"], "v", ["n"], descending=desc, buckets=16).collect()
        for key, weight in (("a", 1), ("b", 2)):
            ordered = sorted((r for r in got if r["k"] == key), key=lambda r: r["v"], reverse=desc)
            assert [r["cum_n"] for r in ordered] == [weight * (i + 1) for i in range(500)]


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 2, 10)], "k string, v double")
    got = exact_quantiles(value_counts(df, ["k"], "v"), ["k"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).first()
    assert (got["q1"], got["m"], got["q3"], got["n"]) == (1.75, 2.0, 4.0, 4)


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    scaler = prep.Scaler.fit(df, ["x"])
    assert [r["x"] for r in scaler.transform(df).collect()] == [0.0, 0.0]


def test_small_values_are_scaled(spark):
    df = spark.createDataFrame([(1, 1e-8), (2, 3e-8)], "id int, x double")
    scaled = prep.Scaler.fit(df, ["x"]).transform(df).orderBy("id").collect()
    assert [round(r["x"], 9) for r in scaled] == [-1.0, 1.0]


def test_unseen_category_raises(spark):
    known = spark.createDataFrame([("a",), ("b",)], "c string")
    new = spark.createDataFrame([("z",)], "c string")
    with pytest.raises(Exception, match="Unseen label|unseen"):
        prep.encode_labels(new, ["c"], known).collect()


def test_direction_does_not_repeat_features(spark):
    cols = [f"c{i}" for i in range(5)]
    df = spark.range(20).select((F.col("id") % 2).alias("y"), *[(F.col("id") * i).alias(f"c{i}") for i in range(5)])
    got = [r["feature"] for r in eda.feature_direction(df, "y", cols).collect()]
    assert sorted(got) == cols


def test_constant_column_has_null_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert eda.correlation_lower(df, ["a", "b"]).first()["r"] is None


def test_leakage_report_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "Age int, GFR double, BMI double")
    assert PATIENTS.leakage_report(df) == {"removed": ["GFR"], "n_removed": 1, "n_remaining": 2}
    assert "GFR" not in PATIENTS.without_leakage().features
    assert replace(PATIENTS, leakage=()).without_leakage().features == PATIENTS.features

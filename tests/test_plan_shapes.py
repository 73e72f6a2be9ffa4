"""Properties of the physical plans that keep the jobs scalable."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.ordering import hash_rank, running_totals
from cohortlab.operators import explain, sampling
from cohortlab.plans import catalog
from cohortlab.session import materialize
from cohortlab.sources.cohorts import cents

PACKAGE = Path(catalog.__file__).resolve().parents[1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ids(spark, small):
    return materialize(catalog.cohort(spark, small).select("row_id", "target"), "ids")


def test_ranks_within_strata_need_no_single_task(ids):
    assert "SinglePartition" not in plan_of(hash_rank(ids, "row_id", 1, ["target"]))


def test_running_totals_need_no_single_task(ids):
    counted = materialize(ids.groupBy("target", "row_id").count(), "c")
    assert "SinglePartition" not in plan_of(running_totals(counted, ["target"], "row_id", ["count"]))


def test_split_does_not_shuffle_the_table(ids):
    """The rows reach the output through broadcast joins with one row per class."""
    plan = plan_of(sampling.stratified_split(ids, catalog.ORDERS))
    spine = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in spine.replace("BroadcastExchange", "")


def test_top_factors_prune_before_the_shuffle(spark, small):
    table, _ = catalog.attributions(spark, small)
    assert "WindowGroupLimit" in plan_of(explain.top_factors(table, "row_id", 3))


def test_scans_read_only_needed_columns(spark, small):
    plan = plan_of(catalog.request_flags(spark, small))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_totalprice" not in schema and "o_orderstatus" in schema


def test_no_forbidden_calls():
    banned = (r"\.crossJoin\(", r"localCheckpoint", r"\.rdd\.(map|flatMap|groupBy)", r"monotonically_increasing_id")
    optional = PACKAGE / "llm"  # has rules and tests of its own
    for source in (s for s in PACKAGE.rglob("*.py") if optional not in s.parents):
        text = source.read_text()
        for pattern in banned:
            assert not re.search(pattern, text), (source, pattern)


def test_cents_round_halves_away_from_zero_without_decimal_text(spark, small):
    values = [0.0, -0.0, 0.005, 0.015, 0.025, -0.005, -0.025, 1.005, 0.00499999999999999, 0.285, 12345.675, 99999.995, -99999.995]
    values += [i / 1000 for i in range(-3000, 3000, 5)] + [4.5e13, -4.5e13, 45035996273704.955, None]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = table.where(~cents(F.col("v")).eqNullSafe(F.round(F.col("v") * 100).cast("bigint")))
    assert wrong.count() == 0
    assert "round(" not in plan_of(catalog.cohort(spark, small))

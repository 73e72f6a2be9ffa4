"""Quantiles by brackets and box statistics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import ordering
from cohortlab.operators import eda

SHARES = {"low": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 0.99}


def numbered(spark, n):
    """Continuous, tied, constant and mostly null columns in two groups of unequal size."""
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    return spark.range(n).select(
        (F.col("id") % 10 == 0).cast("int").alias("target"),
        (h * h / 7.0).alias("wide"),
        (h % 9).alias("tied"),
        F.lit(4).alias("same"),
        F.when(F.col("id") % 1000 == 0, h).alias("rare"),
        F.lit(None).cast("double").alias("none"),
    )


@pytest.mark.parametrize("n", [1, 2, 3, 11, 100, 4_000, 200_000])
def test_equal_numpy(spark, n):
    df = numbered(spark, n)
    got = ordering.bracketed_quantiles(df, "target", ["wide", "tied", "same", "rare", "none"], SHARES)
    rows = df.toPandas()
    keys = set()
    for (g, c), values in ((k, rows.loc[rows.target == k[0], k[1]].dropna()) for k in [(a, b) for a in (0, 1) for b in rows.columns[1:]]):
        if not len(values):
            continue
        keys.add((g, c))
        found = got[g, c]
        assert (found["n"], found["minimum"], found["maximum"]) == (len(values), values.min(), values.max())
        for name, q in SHARES.items():
            assert found[name] == pytest.approx(np.quantile(values.astype(float), q), rel=1e-12)
    assert set(got) == keys


def test_only_rows_in_brackets_are_shuffled(spark, monkeypatch):
    kept = []

    def watch(df, label, inner=ordering.materialize):
        kept.append(inner(df, label))
        return kept[-1]

    monkeypatch.setattr(ordering, "materialize", watch)
    n = 400_000
    ordering.bracketed_quantiles(numbered(spark, n), "target", ["wide"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    assert kept[0].agg(F.sum("n")).first()[0] < 3 * 2 * 0.0012 * n


def test_box_of_each_class(spark):
    df = numbered(spark, 5_000).withColumn("n", F.lit("clash")).withColumn("feature", F.lit(1))
    df = df.unionByName(df.limit(1).withColumns({"target": F.lit(None).cast("int")}))
    got = {(r["feature"], r["target"]): r for r in eda.box_statistics(df, "target", ["wide", "rare", "none", "gone"]).collect()}
    assert set(got) == {("wide", 0), ("wide", 1), ("rare", 1)}
    rows = df.toPandas()
    for (c, g), r in got.items():
        v = rows.loc[rows.target == g, c].dropna().astype(float)
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert r["n"] == len(v) and r["n_outliers"] == len(v) - len(inside)
        assert (r["whisker_low"], r["whisker_high"]) == pytest.approx((inside.min(), inside.max()), abs=1e-3)


def test_empty_table(spark):
    df = numbered(spark, 10).where("target > 5")
    assert ordering.bracketed_quantiles(df, "target", ["wide"], SHARES) == {}
    assert eda.box_statistics(df, "target", ["wide"]).count() == 0

"""Kernel SHAP against Shapley values by their definition."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import kernel_shap as ks

NAMES = [f"f{i}" for i in range(8)]


def curved(x):
    """A score with products, so that features do not just add up."""
    return 1 / (1 + np.exp(-(x[..., 0] * x[..., 1] - x[..., 2] + 0.5 * x[..., 3] * x[..., 4] * x[..., 5] + x[..., 6] ** 2 - x[..., 7])))


def curved_column(df):
    c = F.col
    z = c("f0") * c("f1") - c("f2") + F.lit(0.5) * c("f3") * c("f4") * c("f5") + c("f6") * c("f6") - c("f7")
    return df.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def shapley(row, pool):
    m, phi = len(row), np.zeros(len(row))

    def v(members):
        mixed = pool.copy()
        mixed[:, list(members)] = row[list(members)]
        return curved(mixed).mean()

    for i in range(m):
        others = [j for j in range(m) if j != i]
        for size in range(m):
            weight = factorial(size) * factorial(m - size - 1) / factorial(m)
            phi[i] += weight * sum(v((*s, i)) - v(s) for s in combinations(others, size))
    return phi


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in NAMES))


def test_all_coalitions_give_shapley_values(spark):
    rng = np.random.default_rng(1)
    x, pool = rng.normal(size=(5, 8)), rng.normal(size=(7, 8))
    out = ks.kernel_attributions(table(spark, x), "id", NAMES, table(spark, pool), curved_column).collect()
    assert len(out) == 40 and all(r["base_value"] == pytest.approx(curved(pool).mean()) for r in out)
    for i in range(5):
        got = {r["feature"]: r for r in out if r["id"] == i}
        assert [got[n]["value"] for n in NAMES] == list(x[i])
        assert [got[n]["phi"] for n in NAMES] == pytest.approx(list(shapley(x[i], pool)), abs=1e-9)


def test_sampled_coalitions_add_up_and_come_close(spark):
    rng = np.random.default_rng(2)
    x, pool = rng.normal(size=(20, 8)), rng.normal(size=(7, 8))
    found = ks.kernel_attributions(table(spark, x), "id", NAMES, table(spark, pool), curved_column, budget=100).collect()
    phi = np.zeros((20, 8))
    for r in found:
        phi[r["id"], NAMES.index(r["feature"])] = r["phi"]
    assert np.abs(phi.sum(axis=1) - (curved(x) - curved(pool).mean())).max() < 1e-9
    exact = np.array([shapley(r, pool) for r in x])
    assert np.abs(phi - exact).mean() < 0.1 * np.abs(exact).mean()


def test_additive_score_is_exact_at_the_smallest_budget(spark):
    rng = np.random.default_rng(3)
    x, pool, w = rng.normal(size=(6, 8)), rng.normal(size=(9, 8)), np.arange(1.0, 9.0)
    score = lambda df: df.withColumn("p", sum(F.lit(float(a)) * F.col(n) for a, n in zip(w, NAMES)))
    found = ks.kernel_attributions(table(spark, x), "id", NAMES, table(spark, pool), score, budget=16).collect()
    for r in found:
        j = NAMES.index(r["feature"])
        assert r["phi"] == pytest.approx(w[j] * (x[r["id"], j] - pool[:, j].mean()), abs=1e-8)


def test_masks():
    masks, weights = ks.coalition_masks(5, 100, 42)
    assert len(masks) == 30 and len({tuple(m) for m in masks}) == 30
    masks, weights = ks.coalition_masks(11, 64, 42)
    assert 22 < len(masks) <= 64 and len({tuple(m) for m in masks}) == len(masks)
    total = sum(10 / (s * (11 - s)) for s in range(1, 11))
    assert weights.sum() == pytest.approx(total)
    with pytest.raises(ValueError, match="at least 22"):
        ks.coalition_masks(11, 21, 42)


def test_one_feature_ties_and_empty_tables(spark):
    x = np.zeros((3, 8))
    score = lambda df: df.withColumn("p", F.col("f0") * 2.0)
    pool = table(spark, np.ones((2, 8)))
    one = ks.kernel_attributions(table(spark, x), "id", ["f0"], pool, score).collect()
    assert [(r["base_value"], r["phi"]) for r in one] == [(2.0, -2.0)] * 3
    assert ks.kernel_attributions(table(spark, x).where("id > 9"), "id", NAMES, pool, curved_column, budget=16).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        ks.kernel_attributions(table(spark, x), "id", NAMES, pool.where("id > 9"), curved_column)


def test_scores_in_tasks_agree_with_scored_rows(spark):
    """The kernel machine's numpy scores give the attributions of its column scores; a null is refused both ways."""
    from cohortlab.operators import explain, kernel_svm, models, prep

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    rows, ctx = table(spark, x), models.Context("id", "y", NAMES)
    scaler = prep.Scaler.fit(rows, NAMES)
    factor = kernel_svm.LandmarkFactor.choose(rng.normal(size=(40, 8)), 0.125, 20)
    for f in (factor, kernel_svm.FourierFactor.draw(8, 0.125, 16, 1)):
        width = f(np.zeros((1, 8))).shape[1] + 1
        fitted = models.FittedKernelSvm(scaler, ctx, kernel_svm.KernelSvm(f, rng.normal(size=(2, width)), 1.5, 0.2))
        slow = ks.kernel_attributions(rows, "id", NAMES, rows, fitted.score, 64, 10)
        fast = ks.kernel_attributions(rows, "id", NAMES, rows, fitted.score, 64, 10, in_tasks=fitted.in_tasks())
        walks = [explain.permutation_attributions(rows, "id", NAMES, rows, fitted.score, in_tasks=t) for t in (None, fitted.in_tasks())]
        for a, b in ((slow, fast), walks):
            a, b = ({(r["id"], r["feature"]): (r["base_value"], r["phi"], r["value"]) for r in t.collect()} for t in (a, b))
            assert len(a) == 480 and a.keys() == b.keys()
            assert max(abs(u - v) for key in a for u, v in zip(a[key], b[key])) < 1e-9
    holes = spark.createDataFrame([(1, None, *[0.0] * 7)], rows.schema)
    with pytest.raises(Exception, match="null in feature f0"):
        ks.kernel_attributions(holes, "id", NAMES, rows, fitted.score, 64, 10, in_tasks=fitted.in_tasks()).collect()

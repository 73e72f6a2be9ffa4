from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlab.operators import explain, models
from cohortlab.plans import catalog, fixed_scores

FEATURES = list(catalog.LEAN.features)


@pytest.fixture(scope="module")
def parts(prepared):
    return catalog.split_of(prepared, "train"), catalog.split_of(prepared, "test")


@pytest.fixture(scope="module")
def ctx(prepared):
    return catalog.context(prepared, catalog.LEAN)


def worst_gap(attributions, base, scored, score="p"):
    total = attributions.groupBy("row_id").agg((F.sum("phi") + F.lit(base)).alias("total"))
    joined = total.join(scored.select("row_id", F.col(score).alias("score")), "row_id")
    row = joined.agg(F.max(F.abs(F.col("total") - F.col("score"))).alias("gap"), F.count("*").alias("n")).first()
    return row["gap"], row["n"]


def test_tree_attributions_add_up(parts, ctx):
    train, test = parts
    fitted = models.refined_models()["Decision Tree"](train, ctx)
    table, base = explain.tree_attributions(test, "row_id", FEATURES, fitted.model.stages[-1])
    gap, n = worst_gap(table, base, fitted.score(test))
    assert gap < 1e-9 and n == test.count()


def test_forest_attributions_add_up(parts, ctx):
    train, test = parts
    fitted = models._pipeline_fit(models._forest(8), False, "balanced")(train, ctx)
    table, base = explain.tree_attributions(test, "row_id", FEATURES, fitted.model.stages[-1])
    assert worst_gap(table, base, fitted.score(test))[0] < 1e-9


def test_boosted_attributions_add_up_to_the_margin(parts, ctx, monkeypatch):
    train, test = parts
    monkeypatch.setattr(models, "BOOST_ROUNDS", 4)
    fitted = models._pipeline_fit(models._boosting(3, 0.1, 1.0), False, None)(train, ctx)
    table, base = explain.tree_attributions(test, "row_id", FEATURES, fitted.model.stages[-1])
    margin = fitted.model.transform(test).withColumn("m", vector_to_array("rawPrediction")[1])
    assert worst_gap(table, base, margin, "m")[0] < 1e-9


@pytest.mark.parametrize("table_limit", [9, 0])
def test_path_attributions_equal_the_shapley_definition(monkeypatch, table_limit):
    monkeypatch.setattr(explain, "MAX_TABLE_TESTS", table_limit)
    rng = np.random.default_rng(3)
    # Two leaves over three features with given shares; the values of all subsets define the game.
    group = explain.LeafPaths(
        np.array([[0, 1, 2], [0, 2, 1]]),
        np.array([[-np.inf, 0.0, -1.0], [0.2, -np.inf, -np.inf]]),
        np.array([[0.5, np.inf, 1.0], [np.inf, 0.3, 0.1]]),
        rng.uniform(0.1, 0.9, (2, 3)),
        np.array([1.5, -0.7]),
    )
    x = rng.normal(size=(20, 3))
    got = explain._path_attributions(x, [group])

    def value(row, known):
        total = 0.0
        for leaf in range(2):
            prod = group.leaf_value[leaf]
            for j in range(3):
                f = group.feature[leaf, j]
                inside = group.low[leaf, j] < row[f] <= group.high[leaf, j]
                prod *= float(inside) if f in known else group.share[leaf, j]
            total += prod
        return total

    for row, phi in zip(x, got):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = 0.0
            for size in range(3):
                for s in combinations(others, size):
                    weight = factorial(size) * factorial(2 - size) / factorial(3)
                    want += weight * (value(row, {*s, i}) - value(row, set(s)))
            assert phi[i] == pytest.approx(want, abs=1e-12)


def _random_paths(rng, trees, depth, d):
    """Leaves of random trees over d features whose thresholds are tenths."""
    found = {}
    seen = 0
    for _ in range(trees):
        todo = [(0, {})]
        while todo:
            level, tests = todo.pop()
            f, cut = int(rng.integers(d)), rng.integers(-15, 16) / 10
            low, high, share = tests.get(f, (-np.inf, np.inf, 1.0))
            if level == depth or not low < cut < high:
                found.setdefault(len(tests), []).append((tests, rng.normal(), seen))
                seen += 1
                continue
            left = rng.uniform(0.1, 0.9)
            todo.append((level + 1, {**tests, f: (low, cut, share * left)}))
            todo.append((level + 1, {**tests, f: (cut, high, share * (1 - left))}))
    out = []
    for m, leaves in sorted(found.items()):
        grid = [[(f, *t) for f, t in tests.items()] for tests, _, _ in leaves]
        feature, low, high, share = (np.array([[c[k] for c in row] for row in grid]).reshape(len(leaves), m) for k in range(4))
        values, order = np.array([v for _, v, _ in leaves]), np.array([p for _, _, p in leaves])
        out.append(explain.LeafPaths(feature.astype(int), low, high, share, values, order))
    return out


@pytest.mark.parametrize(("cells", "table_limit"), [(1024, 9), (64, 3), (1, 9)])
def test_one_lookup_explains_neighbouring_leaves(monkeypatch, cells, table_limit):
    monkeypatch.setattr(explain, "BLOCK_CELLS", cells)
    monkeypatch.setattr(explain, "MAX_TABLE_TESTS", table_limit)
    rng = np.random.default_rng(5)
    paths = _random_paths(rng, trees=6, depth=7, d=5)
    leaves = sum(len(g.feature) for g in paths if 0 < g.feature.shape[1] <= table_limit)
    tables = explain.leaf_tables(paths)
    assert sum(len(b.leaf_value) for b in tables.blocks) == leaves
    assert (len(tables.blocks) < leaves / 2) if cells == 1024 else (len(tables.blocks) <= leaves)
    x = rng.integers(-20, 21, (400, 5)) / 10  # many values lie on a threshold
    x[0, 1], x[1, 2], x[2, 0], x[3] = np.nan, -np.inf, np.inf, np.nan
    want = explain._tested_attributions(x, paths)
    assert np.allclose(explain._path_attributions(x, paths), want, atol=1e-12, rtol=0)


def test_batches_are_joined_up_to_a_size():
    batches = [pd.DataFrame({"a": range(i, i + 3)}) for i in range(0, 15, 3)]
    joined = list(explain._joined(iter(batches), 6))
    assert [len(p) for p in joined] == [6, 6, 3] and [*pd.concat(joined)["a"]] == list(range(15))
    assert list(explain._joined(iter([]), 6)) == []


def test_a_tree_without_splits_explains_nothing():
    empty = np.zeros((1, 0))
    leaf = explain.LeafPaths(empty.astype(int), empty, empty, empty, np.array([0.3]))
    assert (explain._path_attributions(np.ones((4, 2)), [leaf]) == 0).all()
    assert explain.tree_base([leaf]) == pytest.approx(0.3)


def test_permutation_attributions_of_a_linear_score(parts):
    _, test = parts
    weights = {"n_lines": 0.5, "qty": 0.25}

    def score(df):
        return df.withColumn("p", fixed_scores.linear_score(1.0, weights))

    table = explain.permutation_attributions(test, "row_id", ["n_lines", "qty"], test, score, rounds=4)
    sums = table.groupBy("row_id").agg((F.sum("phi") + F.first("base_value")).alias("t"))
    gap = sums.join(score(test), "row_id").agg(F.max(F.abs(F.col("t") - F.col("p")))).first()[0]
    assert gap < 1e-9
    assert table.where("feature = 'qty' and phi <> 0").count() > 0


def test_side_factors_and_groups(spark):
    rows = [(1, "a", 1.0, -0.5), (1, "b", 2.0, 0.25), (1, "c", 3.0, 0.0)]
    table = spark.createDataFrame(rows, "row_id int, feature string, value double, phi double")
    sides = {(r["feature"], r["side"]) for r in explain.side_factors(table, "row_id").collect()}
    assert sides == {("a", "protective"), ("b", "risk")}
    groups = {r["group"]: r for r in explain.grouped_importance(table, {"g": ("a",), "h": ("b",)}).collect()}
    assert groups["g"]["percent"] == pytest.approx(66.6667)
    assert groups["ungrouped"]["percent"] is None


def test_other_models_are_refused(parts, ctx):
    train, _ = parts
    fitted = models.refined_models()["Naive Bayes"](train, ctx)
    with pytest.raises(Exception):
        explain.leaf_paths(fitted.model.stages[-1])

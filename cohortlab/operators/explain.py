"""Additive explanations of predictions.

All explainers give the same long table: ``id, feature, value, phi``, where for
every row the ``phi`` add up to the score minus a base value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.expressions import hash_key, hash_u32
from cohortlab.operators.random_trees import strict_double
from cohortlab.session import scratch_path, spread

DIGITS = 6
TOP_FACTORS = 10
SIDE_FACTORS = 8
BACKGROUND_ROWS = 50
MAX_TREE_NODES = 2_000_000
PATH_TILE = 2_000_000
MAX_TABLE_TESTS = 9
BLOCK_CELLS = 1_024  # cells of a block's table at most, if it has more leaves than one
BLOCK_LEAVES = 32
EXPLAINED_ROWS = 131_072  # rows of a task explained at once
WALK_ROWS = 8_192  # mixed rows scored at once
ROWS_PER_TASK = 500  # rows explained per task on a small table


def _stack(df: DataFrame, ids, features, value: Callable[[str], Column], phi: Callable[[str], Column]) -> DataFrame:
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            value(f).cast("double").alias("value"),
            phi(f).cast("double").alias("phi"),
        )
        for f in features
    ]
    return df.select(*ids, F.explode(F.array(*parts)).alias("_r")).select(*ids, "_r.*")


# --- linear models -------------------------------------------------------------


def linear_attributions(df: DataFrame, id_col: str, coefficients: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Exact Shapley values of a linear score: coefficient times distance from the mean."""
    return _stack(
        df,
        [id_col],
        coefficients,
        lambda f: F.col(f),
        lambda f: F.round(F.lit(coefficients[f]) * (F.col(f).cast("double") - F.lit(means[f])), DIGITS),
    )


def linear_base(intercept: float, coefficients: dict[str, float], means: dict[str, float]) -> float:
    """Score of the mean row."""
    total = intercept
    for f, w in coefficients.items():
        total += w * means[f]
    return total


# --- trees ---------------------------------------------------------------------


@dataclass(frozen=True)
class LeafPaths:
    """Leaves of an ensemble that test the same number of features.

    ``feature``, ``low``, ``high`` and ``share`` have one row per leaf and one
    column per tested feature: the row reaches the leaf when low < x <= high for
    all of them, and ``share`` is the part of the training rows that the tests on
    this feature let through.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    leaf_value: np.ndarray
    order: np.ndarray | None = None  # place of each leaf among all, neighbours in a tree being next to each other


def _tree_nodes(model) -> tuple[pd.DataFrame, list[float]]:
    """Node table of a tree model as saved by Spark, and the weight of each tree."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
        weights = list(model.treeWeights)
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
        weights = [1.0]
    # The number of trees and their depth bound the table, whatever the data size.
    size = nodes.count()
    if size > MAX_TREE_NODES:
        raise ValueError(f"{size} tree nodes are more than the {MAX_TREE_NODES} that are sent to tasks")
    table = nodes.select(
        "tree",
        "id",
        "leftChild",
        "rightChild",
        "prediction",
        "impurityStats",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    return table.toPandas(), weights


def leaf_paths(model) -> list[LeafPaths]:
    """Paths of all leaves, grouped by their number of tested features.

    Leaf values are probabilities for a tree or forest (averaged over trees) and
    margins for boosted trees.
    """
    nodes, weights = _tree_nodes(model)
    boosted = isinstance(model, GBTClassificationModel)
    if not boosted and not isinstance(model, (RandomForestClassificationModel, DecisionTreeClassificationModel)):
        raise TypeError(f"not a tree model: {type(model).__name__}")
    found: dict[int, list] = {}
    seen = 0
    for tree, part in nodes.groupby("tree"):
        rows = {r.id: r for r in part.itertuples(index=False)}
        cover = {i: (r.impurityStats[0] if boosted else sum(r.impurityStats)) for i, r in rows.items()}
        # Boosted margins use the given weights; a forest averages its trees.
        scale = weights[int(tree)] if boosted else 1.0 / len(weights)
        todo = [(0, {})]
        while todo:
            i, tests = todo.pop()
            node = rows[i]
            if node.leftChild < 0:
                value = node.prediction if boosted else node.impurityStats[1] / sum(node.impurityStats)
                found.setdefault(len(tests), []).append((tests, value * scale, seen))
                seen += 1
                continue
            f, cut = int(node.feature), float(node.threshold)
            low, high, share = tests.get(f, (-np.inf, np.inf, 1.0))
            left, right = node.leftChild, node.rightChild
            todo.append((left, {**tests, f: (low, min(high, cut), share * cover[left] / cover[i])}))
            todo.append((right, {**tests, f: (max(low, cut), high, share * cover[right] / cover[i])}))
    out = []
    for m, leaves in sorted(found.items()):
        grid = [[(f, *t) for f, t in tests.items()] for tests, _, _ in leaves]
        shape = (len(leaves), m)
        columns = [np.array([[c[k] for c in row] for row in grid]).reshape(shape) for k in range(4)]
        values, order = np.array([v for _, v, _ in leaves]), np.array([place for _, _, place in leaves])
        out.append(LeafPaths(columns[0].astype(int), columns[1], columns[2], columns[3], values, order))
    return out


@cache
def _legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _gains(own: np.ndarray, share: np.ndarray, leaf_value: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf's tests, for test results ``own`` (..., leaves, tests).

    For one leaf the expectation over a feature subset is a product with one
    factor per feature: the row's own test result if the feature is known, the
    share of training rows if not.  The Shapley weights average that product over
    t in [0, 1] with each factor mixed as share*(1-t) + own*t; the integrand is a
    polynomial in t, so Gauss-Legendre nodes give it exactly.
    """
    node, weight = _legendre((share.shape[-1] + 1) // 2)
    total = np.zeros(np.broadcast_shapes(own.shape, share.shape))
    for t, w in zip((node + 1) / 2, weight / 2):
        factor = share * (1 - t) + own * t
        total += w * factor.prod(axis=-1, keepdims=True) / factor
    return (own - share) * total * leaf_value[:, None]


@dataclass(frozen=True)
class LeafBlock:
    """Neighbouring leaves, explained by one lookup: the results of all their tests are one cell of a table.

    ``results`` has for each tested feature the distinct results of its tests, as rows of the leaves that they let
    through; ``cell`` has for each of them the summand of the cell number in every bin of the feature's values.
    """

    feature: list[int]
    results: list[np.ndarray]
    cell: list[np.ndarray]
    share: np.ndarray  # a row for each leaf, a column for each feature; 1 where the leaf does not test it
    leaf_value: np.ndarray

    def table(self) -> np.ndarray:
        """Gains of the leaves together, a row for each feature and a column for each cell."""
        leaves, m = self.share.shape
        passed = (np.arange(2**m)[:, None, None] >> np.arange(m)) & 1
        gains = _gains(passed.astype(float), self.share, self.leaf_value)
        found = np.indices([len(r) for r in self.results]).reshape(m, -1)
        code = sum(r[i].astype(np.int64) << j for j, (r, i) in enumerate(zip(self.results, found)))
        return np.ascontiguousarray(gains[code, np.arange(leaves)].sum(axis=1).T)


@dataclass(frozen=True)
class LeafTables:
    """The leaves of an ensemble in blocks; ``cuts`` has each feature's thresholds, which bound its bins."""

    cuts: dict[int, np.ndarray]
    blocks: list[LeafBlock]
    rest: list[LeafPaths]  # leaves with too many tests for a table


def _block(fails: dict[int, list[int]], leaves: list[tuple[dict, float]]) -> LeafBlock:
    """Block of leaves from the leaves (as bits) that each bin of a feature fails."""
    results, cell, stride = [], [], 1
    for marks in reversed(fails.values()):  # the last feature's results count fastest in a table
        distinct, place = np.unique(marks, return_inverse=True)
        results.append((distinct[:, None] >> np.arange(len(leaves))) & 1 == 0)
        cell.append((place * stride).astype(np.int32))
        stride *= len(distinct)
    share = np.array([[tests[f][2] if f in tests else 1.0 for f in fails] for tests, _ in leaves])
    return LeafBlock([*fails], results[::-1], cell[::-1], share, np.array([v for _, v in leaves]))


def leaf_tables(paths: list[LeafPaths]) -> LeafTables:
    """Blocks of leaves that follow each other in their tree, as many as a table of BLOCK_CELLS cells holds."""
    small = [g for g in paths if 0 < g.feature.shape[1] <= MAX_TABLE_TESTS]
    tested = {int(f) for g in small for f in np.unique(g.feature)}
    cuts = {}
    for f in sorted(tested):
        ends = np.concatenate([side[g.feature == f] for g in small for side in (g.low, g.high)])
        cuts[f] = np.unique(ends[np.isfinite(ends)])
    leaves = []
    for g in small:
        first, last = np.zeros(g.feature.shape, dtype=int), np.zeros(g.feature.shape, dtype=int)
        for f, at in cuts.items():
            own = g.feature == f
            first[own], last[own] = np.searchsorted(at, g.low[own], "right"), np.searchsorted(at, g.high[own], "left")
        grid = zip(g.feature.tolist(), first.tolist(), last.tolist(), g.share.tolist())
        order = np.zeros(len(g.feature), dtype=int) if g.order is None else g.order
        tests = [dict(zip(f, zip(lo, hi, share))) for f, lo, hi, share in grid]
        leaves += zip(order.tolist(), tests, g.leaf_value.tolist())
    leaves.sort(key=lambda leaf: leaf[0])
    blocks, fails, held = [], {}, []
    for _, tests, value in leaves:
        grown = _failing(fails, tests, len(held), cuts)
        if held and (len(held) == BLOCK_LEAVES or math.prod(len(set(m)) for m in grown.values()) > BLOCK_CELLS):
            blocks.append(_block(fails, held))
            grown, held = _failing({}, tests, 0, cuts), []
        fails = grown
        held.append((tests, value))
    if held:
        blocks.append(_block(fails, held))
    return LeafTables(cuts, blocks, [g for g in paths if g.feature.shape[1] > MAX_TABLE_TESTS])


def _failing(fails: dict[int, list[int]], tests: dict, number: int, cuts: dict[int, np.ndarray]) -> dict[int, list[int]]:
    """``fails`` with one more leaf: its bit is set in the bins that fail its test."""
    bit, out = 1 << number, dict(fails)
    for f, (first, last, _) in tests.items():
        marks = out.get(f) or [0] * (len(cuts[f]) + 1)
        out[f] = [m | bit for m in marks[:first]] + marks[first : last + 1] + [m | bit for m in marks[last + 1 :]]
    return out


def _tested_attributions(x: np.ndarray, paths: list[LeafPaths]) -> np.ndarray:
    """Shapley values by every leaf's tests of every row."""
    n, d = x.shape
    phi = np.zeros((n, d))
    for group in paths:
        leaves, m = group.feature.shape
        if m == 0:
            continue
        target = np.zeros((leaves * m, d))
        target[np.arange(leaves * m), group.feature.ravel()] = 1.0
        step = max(1, PATH_TILE // (leaves * m))
        for start in range(0, n, step):
            cell = x[start : start + step][:, group.feature]
            own = ((cell > group.low) & (cell <= group.high)).astype(float)
            gain = _gains(own, group.share, group.leaf_value)
            phi[start : start + step] += gain.reshape(len(cell), -1) @ target
    return phi


def _path_attributions(x: np.ndarray, paths: list[LeafPaths], tables: LeafTables | None = None) -> np.ndarray:
    """Shapley values of the path-dependent tree expectation for every row of ``x``.

    The gains of a leaf depend only on which of its tests a row passes, so they are looked up by the results, for a
    block of leaves at once.  A block's table is made when its turn comes: only one is held at a time.
    """
    tables = tables or leaf_tables(paths)
    phi = np.zeros(x.shape)
    # No value lies in the bins of a missing number or passes a test below -inf.
    odd = ~(x > -np.inf).all(axis=1)
    phi[odd] = _tested_attributions(x[odd], paths)
    plain = x[~odd]
    bins = {f: np.searchsorted(at, plain[:, f], "left") for f, at in tables.cuts.items()}
    found = np.zeros(plain.shape[::-1])
    for block in tables.blocks if len(plain) else ():
        cell = sum(at.take(bins[f]) for f, at in zip(block.feature, block.cell))
        for f, gains in zip(block.feature, block.table()):
            found[f] += gains.take(cell)
    phi[~odd] = found.T + _tested_attributions(plain, tables.rest)
    return phi


def tree_base(paths: list[LeafPaths]) -> float:
    """Expected output of the ensemble over its training rows."""
    return float(sum((g.leaf_value * g.share.prod(axis=1)).sum() for g in paths))


def _joined(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches, put together until they have so many rows."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def tree_attributions(df: DataFrame, id_col: str, features, model) -> tuple[DataFrame, float]:
    """Exact path-dependent Shapley values (Lundberg et al. 2018) of a tree model, and the base value.

    The leaf table travels to the tasks; rows are explained where they are, without a shuffle,
    so many at a time that making the lookup tables costs little.
    """
    features = list(features)
    paths = leaf_paths(model)
    tables = leaf_tables(paths)
    phi_cols = [f"_phi_{f}" for f in features]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _joined(batches, EXPLAINED_ROWS):
            out[phi_cols] = _path_attributions(out[features].to_numpy(float), paths, tables)
            yield out

    base = df.select(F.col(id_col).cast("bigint").alias(id_col), *[F.col(f).cast("double").alias(f) for f in features])
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.DoubleType()) for c in phi_cols]])
    wide = spread(base, ROWS_PER_TASK).mapInPandas(explain, schema)
    return _stack(wide, [id_col], features, lambda f: F.col(f), lambda f: F.col(f"_phi_{f}")), tree_base(paths)


# --- any model -------------------------------------------------------------------


@dataclass(frozen=True)
class TaskScores:
    """A model's ``p`` as functions of numpy rows, so that mixed rows need not leave the task that explains them.

    ``rows`` scores (n, features); ``mixed`` scores (own rows, background rows, masks of the own values) as
    (own, masks, background). Rows with a null or NaN are refused before.
    """

    rows: Callable[[np.ndarray], np.ndarray]
    mixed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def own_values(batch: pa.RecordBatch, column: str, width: int, dtype=float) -> np.ndarray:
    """An array column whose rows all have ``width`` entries."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, width)


def explained_rows(batch: pa.RecordBatch, kept: list[str], base: np.ndarray, phi: np.ndarray) -> pa.RecordBatch:
    """The ``kept`` columns with a base value and an array of attributions."""
    ends = pa.array(np.arange(len(phi) + 1) * phi.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(base), lists], names=[*kept, "_base", "_phis"])


def strict_pool(picked, features) -> np.ndarray:
    """Background rows as numbers; a null or NaN is an error."""
    pool = np.array([[np.nan if r[f] is None else float(r[f]) for f in features] for r in picked])
    for f, bad in zip(features, np.isnan(pool).any(axis=0)):
        if bad:
            raise ValueError(f"null in feature {f} of the background")
    return pool


def _walked(base: DataFrame, id_col: str, pool: np.ndarray, pairs: list[tuple[Column, Column]], rounds: int, scores: TaskScores) -> DataFrame:
    """Base value and attributions of every row, walked and scored inside the task that holds it."""
    d = pool.shape[1]
    slots = [slot.alias(f"_slot{i}") for i, (slot, _) in enumerate(pairs)]
    orders = [order.alias(f"_order{i}") for i, (_, order) in enumerate(pairs)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, start = np.zeros((batch.num_rows, d)), np.zeros(batch.num_rows)
            own = own_values(batch, "_own", d)
            for k in range(rounds):
                order = own_values(batch, f"_order{k // 2}", d, int)
                order = order if k % 2 == 0 else order[:, ::-1]
                slot = batch.column(f"_slot{k // 2}").to_numpy(zero_copy_only=False)
                step = max(1, WALK_ROWS // (d + 1))
                for at in range(0, len(own), step):
                    part = slice(at, at + step)
                    place = np.argsort(order[part], axis=1)  # of each feature in the order
                    taken = place[:, None, :] < np.arange(d + 1)[None, :, None]
                    x = np.where(taken, own[part, None, :], pool[slot[part]][:, None, :])
                    p = scores.rows(x.reshape(-1, d)).reshape(len(place), d + 1)
                    start[part] += p[:, 0]
                    total[part] += np.take_along_axis(np.diff(p, axis=1), place, axis=1)
            yield explained_rows(batch, [id_col, "_own"], start / rounds, total / rounds)

    fields = [base.schema[id_col], T.StructField("_own", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*fields, T.StructField("_base", T.DoubleType()), T.StructField("_phis", T.ArrayType(T.DoubleType()))])
    found = base.select(id_col, "_own", *slots, *orders).mapInArrow(walk, schema)
    sums = [F.sum(F.col("_phis")[i]).alias(str(i)) for i in range(d)]
    return found.groupBy(id_col, "_own").agg(F.sum("_base").alias("-1"), *sums)


def permutation_attributions(
    df: DataFrame,
    id_col: str,
    features,
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    rounds: int = 4,
    seed: int = 42,
    in_tasks: TaskScores | None = None,
) -> DataFrame:
    """Sampled Shapley values of any model (Strumbelj & Kononenko 2014).

    In each round a row starts as a background row and takes over its own values
    one feature at a time, in a random order; odd rounds use the reverse order of
    the round before.  All steps are rows of one table that is scored once.
    ``background`` supplies up to 50 rows in hash order; ``score`` adds ``p``, or
    ``in_tasks`` gives the same scores where the rows are, without moving the steps.
    Per row the ``phi`` add up to its score minus the mean score of the
    background rows it was compared with, given in ``base_value``.
    """
    features = list(features)
    picked = (
        background.select(id_col, *features)
        .orderBy(hash_key(id_col, f"{seed}|bg"), id_col)
        .limit(BACKGROUND_ROWS)
        .collect()
    )
    strict = strict_double if in_tasks else lambda f: F.col(f).cast("double")
    own = F.array(*[strict(f) for f in features])
    base = spread(df.select(F.col(id_col).cast("bigint").alias(id_col), own.alias("_own")), ROWS_PER_TASK)

    def draws(pair: Column) -> tuple[Column, Column]:
        """Background row and feature order of a pair of rounds."""
        mark = F.concat_ws("|", F.col(id_col).cast("string"), pair.cast("string"))
        slot = F.pmod(hash_u32(hash_key(mark, f"{seed}|b")), F.lit(len(picked))).cast("int")
        keyed = [
            F.struct(hash_key(mark, f"{seed}|{i}").alias("h"), F.lit(i).alias("i")) for i in range(len(features))
        ]
        return slot, F.transform(F.array_sort(F.array(*keyed)), lambda s: s["i"])

    if in_tasks:
        pairs = [draws(F.lit(i)) for i in range((rounds + 1) // 2)]
        return _named(_walked(base, id_col, strict_pool(picked, features), pairs, rounds, in_tasks), id_col, features)
    pool = F.array(*[F.array(*[F.lit(float(r[f])) for f in features]) for r in picked])
    slot, forward = draws(F.floor(F.col("_round") / 2).cast("int"))
    order = F.when(F.col("_round") % 2 == 0, forward).otherwise(F.reverse(forward))
    rounds_table = (
        base.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        .withColumn("_bg", F.element_at(pool, slot + 1))
        .withColumn("_order", order)
    )
    steps = rounds_table.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    # After step s the first s features of the order hold the row's own values.
    values = {
        f: F.when(F.array_position(F.col("_order"), F.lit(i)) <= F.col("_step"), F.col("_own")[i]).otherwise(
            F.col("_bg")[i]
        )
        for i, f in enumerate(features)
    }
    scored = score(steps.withColumns(values))
    # Each scored step ends one feature's change and starts the next one's.
    ends = F.when(
        F.col("_step") > 0,
        F.struct(F.col("_order")[F.greatest(F.col("_step") - 1, F.lit(0))].alias("i"), F.col("p").alias("d")),
    )
    last = len(features)
    starts = F.when(
        F.col("_step") < last,
        F.struct(F.col("_order")[F.least(F.col("_step"), F.lit(last - 1))].alias("i"), (-F.col("p")).alias("d")),
    )
    start_score = F.when(F.col("_step") == 0, F.struct(F.lit(-1).alias("i"), F.col("p").alias("d")))
    moves = scored.select(id_col, "_own", F.explode(F.array_compact(F.array(ends, starts, start_score))).alias("_m"))
    summed = moves.groupBy(id_col, "_own").pivot("_m.i", list(range(-1, last))).agg(F.sum("_m.d") / rounds)
    return _named(summed, id_col, features)


def _named(summed: DataFrame, id_col: str, features) -> DataFrame:
    """Long table of a row's sums in the columns -1 (base value), 0, 1, ..."""
    index = {f: i for i, f in enumerate(features)}
    return _stack(
        summed.withColumnRenamed("-1", "base_value"),
        [id_col, "base_value"],
        features,
        lambda f: F.col("_own")[index[f]],
        lambda f: F.col(f"`{index[f]}`"),
    )


# --- tables made from attributions ------------------------------------------------


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    out = attributions.groupBy("feature").agg(F.round(F.avg(F.abs("phi")), DIGITS).alias("mean_abs_phi"))
    return out.orderBy(F.desc("mean_abs_phi"), "feature")


def grouped_importance(attributions: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Importance added up per feature group, and percent of the grouped total.

    Features outside all groups are listed as 'ungrouped' and kept out of the
    percent.
    """
    pairs = [(g, f) for g, members in groups.items() for f in members]
    names = [f for _, f in pairs]
    lookup = attributions.sparkSession.createDataFrame(pairs, "group string, feature string")
    per_feature = attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("_m"))
    # The lookup has one row per named feature.
    labelled = per_feature.join(F.broadcast(lookup), "feature", "left").withColumn(
        "group", F.coalesce("group", F.lit("ungrouped"))
    )
    per_group = labelled.groupBy("group").agg(F.sum("_m").alias("_t"))
    total = F.sum(F.when(F.col("group") != "ungrouped", F.col("_t"))).over(Window.partitionBy())
    percent = F.when(F.col("group") != "ungrouped", F.col("_t") / F.when(total > 0, total).otherwise(1.0) * 100)
    assert len(set(names)) == len(names), "a feature is in two groups"
    return per_group.select(
        "group", F.round("_t", DIGITS).alias("importance"), F.round(percent, 4).alias("percent")
    )


def top_factors(attributions: DataFrame, id_col: str, n: int = TOP_FACTORS) -> DataFrame:
    """The n features with the largest absolute contribution per row, signed."""
    order = Window.partitionBy(id_col).orderBy(F.abs("phi").desc(), "feature")
    ranked = attributions.withColumn("factor_rank", F.row_number().over(order))
    return ranked.where(F.col("factor_rank") <= n)


def side_factors(attributions: DataFrame, id_col: str, n: int = SIDE_FACTORS) -> DataFrame:
    """Per row the n strongest protective (negative) and risk (positive) features."""
    side = F.when(F.col("phi") < 0, "protective").when(F.col("phi") > 0, "risk")
    signed = attributions.withColumn("side", side).where(F.col("side").isNotNull())
    order = Window.partitionBy(id_col, "side").orderBy(F.abs("phi").desc(), "feature")
    return signed.withColumn("side_rank", F.row_number().over(order)).where(F.col("side_rank") <= n)


def waterfall(attributions: DataFrame, id_col: str, base_value: float) -> DataFrame:
    """Running score from the base value through the contributions, largest first."""
    order = Window.partitionBy(id_col).orderBy(F.abs("phi").desc(), "feature")
    running = F.sum("phi").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return attributions.withColumns(
        {
            "step": F.row_number().over(order),
            "base_value": F.lit(round(base_value, DIGITS)),
            "running_score": F.round(F.lit(base_value) + running, 4),
        }
    )


def beeswarm(attributions: DataFrame) -> DataFrame:
    """Contribution and feature value per row, with the value's place in the feature's range.

    The place (0 lowest, 1 highest) is what colours the dots.
    """
    limits = attributions.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    # One row per feature.
    joined = attributions.join(F.broadcast(limits), "feature")
    width = F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, (F.col("value") - F.col("_lo")) / width).otherwise(0.5)
    return joined.withColumn("value_place", F.round(place, 4)).drop("_lo", "_hi")

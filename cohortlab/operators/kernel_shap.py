"""Kernel SHAP: Shapley values of any model by weighted least squares over coalitions (Lundberg & Lee 2017).

The score of a coalition S of features is the mean score of the background rows after they take over the explained row's values
in S. The attributions are the additive model that fits the coalition scores best under the Shapley kernel weights, bound
to add up to the row's score minus the mean background score. All rows share one set of coalitions, so the normal equations are
solved once and an attribution is a fixed weighted sum of coalition scores: Spark makes the mixed rows, scores them in
one pass and adds them up, mostly inside the task that made them.

With every coalition in the set (2^features within the budget) the result is the exact Shapley value. A smaller budget takes whole
sizes from the outside in (1 and all but 1, 2 and all but 2, ...), then draws pairs of a coalition and its complement from the sizes
that are left; models that are additive in the features still come out exactly.

Ids name rows of the explained table once. The empty table gives an empty result, an empty background is an error; how nulls are
scored is the model's matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.expressions import hash_key
from cohortlab.operators.explain import BACKGROUND_ROWS, ROWS_PER_TASK, TaskScores, explained_rows, own_values, strict_pool
from cohortlab.operators.random_trees import strict_double
from cohortlab.session import spread

BUDGET = 2048  # coalitions beside twice the number of features
SCORED = 524_288  # mixed rows scored at once
MAX_FEATURES = 62  # a coalition is the bits of a long


def kernel_weight(features: int, size: int) -> float:
    """Weight of one coalition of this size."""
    return (features - 1) / (comb(features, size) * size * (features - size))


def coalition_masks(features: int, budget: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions without the empty and the full one, as rows of 0 and 1, and their weights."""
    if budget < 2 * features:
        raise ValueError(f"at least {2 * features} coalitions are needed for {features} features")
    masks, weights, left = [], [], budget
    sizes = sorted(range(1, features), key=lambda s: (min(s, features - s), s))
    pairs = [[s for s in sizes if min(s, features - s) == low] for low in range(1, features // 2 + 1)]
    while pairs and sum(comb(features, s) for s in pairs[0]) <= left:
        for size in pairs.pop(0):
            for members in combinations(range(features), size):
                mask = np.zeros(features)
                mask[list(members)] = 1
                masks.append(mask)
                weights.append(kernel_weight(features, size))
                left -= 1
    if pairs and left >= 2:
        rest = [s for pair in pairs for s in pair]
        share = np.array([comb(features, s) * kernel_weight(features, s) for s in rest])
        rng = np.random.default_rng(seed)
        drawn: dict[tuple, int] = {}
        for size in rng.choice(rest, size=left // 2, p=share / share.sum()):
            mask = np.zeros(features)
            mask[rng.choice(features, size=size, replace=False)] = 1
            for one in (mask, 1 - mask):
                drawn[tuple(one)] = drawn.get(tuple(one), 0) + 1
        total = sum(drawn.values())
        for mask, n in drawn.items():
            masks.append(np.array(mask))
            weights.append(share.sum() * n / total)
    return np.array(masks).reshape(-1, features), np.array(weights)


def coalition_coefficients(masks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(C, M) coefficients of the coalition scores, and those of the background mean and of the row's own score.

    Solves min sum w*(v - base - mask.phi)^2 with sum(phi) = own - base, once for all rows.
    """
    features = masks.shape[1]
    if not len(masks):
        return masks, -np.ones(features), np.ones(features)
    inverse = np.linalg.inv((masks.T * weights) @ masks)
    own = inverse.sum(axis=1) / inverse.sum()
    solve = (inverse - np.outer(own, inverse.sum(axis=0))) @ (masks.T * weights)
    return solve.T, -solve.sum(axis=1) - own, own


def kernel_attributions(
    df: DataFrame,
    id_col: str,
    features,
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    budget: int | None = None,
    background_rows: int = BACKGROUND_ROWS,
    seed: int = 42,
    in_tasks: TaskScores | None = None,
) -> DataFrame:
    """``id, base_value, feature, value, phi`` for every row of ``df``; ``score`` adds ``p``.

    ``background`` supplies its first ``background_rows`` rows in hash order. Each row of ``df`` is scored
    (coalitions + 2) * background_rows times; no more than a row's sums leave the task. With ``in_tasks`` the
    model scores numpy rows there and the mixed rows are not made as Spark rows.
    """
    features = list(features)
    if len(features) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    picked = background.orderBy(hash_key(id_col, f"{seed}|bg"), id_col).select(*features).limit(background_rows).collect()
    if not picked:
        raise ValueError("the background has no rows")
    masks, weights = coalition_masks(len(features), budget or BUDGET + 2 * len(features), seed)
    inner, base, own = coalition_coefficients(masks, weights)
    bits = [int(sum(1 << i for i in np.flatnonzero(m))) for m in masks]
    table = [(0, base.tolist()), ((1 << len(features)) - 1, own.tolist()), *zip(bits, inner.tolist())]
    if in_tasks:
        pool = strict_pool(picked, features)
        added = _fitted(df, id_col, features, pool, np.array([c for _, c in table]), [b for b, _ in table], in_tasks)
        return _long(added, id_col, features)
    # bounded by the budget
    coalitions = df.sparkSession.createDataFrame([(i, b, c) for i, (b, c) in enumerate(table)], "_i int, _bits long, _c array<double>")

    values = F.array(*[F.col(f).cast("double") for f in features])
    pool = F.array(*[F.array(*[F.lit(None if r[f] is None else float(r[f])).cast("double") for f in features]) for r in picked])
    rows = spread(df.select(F.col(id_col), values.alias("_own")), ROWS_PER_TASK)
    mixed = (
        rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(table) - 1))))
        .join(F.broadcast(coalitions), "_i")
        .withColumn("_bg", F.explode(pool))
    )
    taken = {
        f: F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("_own")[i]).otherwise(F.col("_bg")[i])
        for i, f in enumerate(features)
    }
    scored = score(mixed.withColumns(taken))
    n = float(len(picked))
    sums = [(F.sum(F.col("p") * F.col("_c")[i]) / n).alias(f"_phi{i}") for i in range(len(features))]
    mean = (F.sum(F.when(F.col("_bits") == 0, F.col("p"))) / n).alias("base_value")
    added = scored.groupBy(id_col, "_own").agg(mean, *sums)
    return _long(added, id_col, features)


def _fitted(df: DataFrame, id_col: str, features, pool: np.ndarray, solve: np.ndarray, bits: list[int], scores: TaskScores) -> DataFrame:
    """Base value and attributions of every row, from coalitions made and scored in numpy; ``solve`` has a row for each."""
    d = len(features)
    masks = np.array([[b >> i & 1 for i in range(d)] for b in bits], dtype=float)
    step = max(1, SCORED // (len(masks) * max(len(pool), d)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = own_values(batch, "_own", d)
            parts = [scores.mixed(own[at : at + step], pool, masks).mean(axis=2) for at in range(0, len(own), step)]
            means = np.concatenate(parts) if parts else np.zeros((0, len(masks)))
            yield explained_rows(batch, [id_col, "_own"], means[:, bits.index(0)], means @ solve)

    rows = spread(df.select(F.col(id_col), F.array(*[strict_double(f) for f in features]).alias("_own")), ROWS_PER_TASK)
    doubles = T.ArrayType(T.DoubleType())
    fields = [rows.schema[id_col], T.StructField("_own", doubles), T.StructField("_base", T.DoubleType()), T.StructField("_phis", doubles)]
    sums = [F.sum(F.col("_phis")[i]).alias(f"_phi{i}") for i in range(d)]
    found = rows.mapInArrow(fit, T.StructType(fields))
    return found.groupBy(id_col, "_own").agg(F.sum("_base").alias("base_value"), *sums)


def _long(added: DataFrame, id_col: str, features) -> DataFrame:
    parts = [
        F.struct(F.lit(f).alias("feature"), F.col("_own")[i].alias("value"), F.col(f"_phi{i}").alias("phi"))
        for i, f in enumerate(features)
    ]
    return added.select(id_col, "base_value", F.explode(F.array(*parts)).alias("_r")).select(id_col, "base_value", "_r.*")

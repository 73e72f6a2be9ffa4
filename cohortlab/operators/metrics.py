"""Metrics, all computed from one long predictions table.

``predictions(experiment, model, row_id, y, p, yhat)`` is the only input.  Every
metric that depends on labels alone comes from one aggregate of the four
confusion counts per (experiment, model).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.expressions import (
    add_all,
    count_where,
    long_form,
    quadrant,
    ratio,
    relabel,
    steps_passed,
)
from cohortlab.functions.ordering import hash_rank
from cohortlab.session import materialize

KEYS = ("experiment", "model")
THRESHOLDS = tuple(i / 20 for i in range(1, 19))
DIGITS = 4
ROWS_PER_SORT = 500_000  # rows that one task puts in hash order


def confusion_counts(predictions: DataFrame, keys=KEYS) -> DataFrame:
    """tp, fp, tn, fn per group, one shuffle."""
    cell = quadrant(F.col("y"), F.col("yhat"))
    return predictions.groupBy(*keys).agg(
        *[count_where(cell == name).alias(name.lower()) for name in ("TP", "FP", "TN", "FN")]
    )


def _mean_of_present(parts) -> Column:
    """Mean over the (value, present) pairs that are present."""
    total = add_all([F.when(here, value).otherwise(F.lit(0.0)) for value, here in parts])
    number = add_all([here.cast("int") for _, here in parts])
    return ratio(total, number)


def metric_columns() -> dict[str, Column]:
    """Metric expressions over the columns tp, fp, tn, fn, unrounded."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    # A class counts in a macro mean when it occurs among the true or predicted labels.
    neg_seen, pos_seen = (tn + fp + fn) > 0, (tp + fp + fn) > 0
    neg_true, pos_true = (tn + fp) > 0, (tp + fn) > 0
    precision = [ratio(tn, tn + fn, 0.0), ratio(tp, tp + fp, 0.0)]
    recall = [ratio(tn, tn + fp, 0.0), ratio(tp, tp + fn, 0.0)]
    f1 = [ratio(tn * 2, tn * 2 + fn + fp, 0.0), ratio(tp * 2, tp * 2 + fp + fn, 0.0)]
    d_n = n.cast("double")
    agree = (tp + tn).cast("double") / d_n
    chance = (
        (tp + fp).cast("double") * (tp + fn).cast("double")
        + (fn + tn).cast("double") * (fp + tn).cast("double")
    ) / (d_n * d_n)
    seen = [neg_seen, pos_seen]
    return {
        "accuracy": agree,
        "balanced_accuracy": _mean_of_present([(recall[0], neg_true), (recall[1], pos_true)]),
        "precision": precision[1],
        "recall": recall[1],
        "f1": f1[1],
        "macro_precision": _mean_of_present(list(zip(precision, seen))),
        "macro_recall": _mean_of_present(list(zip(recall, seen))),
        "macro_f1": _mean_of_present(list(zip(f1, seen))),
        "cohen_kappa": F.when(chance != 1.0, (agree - chance) / (F.lit(1.0) - chance)),
    }


def score_counts(counts: DataFrame, names=None, digits: int = DIGITS) -> DataFrame:
    """Add rounded metric columns to a table of confusion counts."""
    columns = metric_columns()
    chosen = names or list(columns)
    return counts.withColumns({c: F.round(columns[c], digits) for c in chosen})


def leaderboard(predictions: DataFrame, auc: DataFrame | None = None, rank_by: str = "balanced_accuracy") -> DataFrame:
    """One row per (experiment, model), best first within the experiment.

    ``auc`` is an optional ``roc_auc`` table to attach.  Equal scores are ordered
    by model name.
    """
    board = score_counts(confusion_counts(predictions)).drop("tp", "fp", "tn", "fn")
    if auc is not None:
        board = board.join(auc, list(KEYS))
    order = Window.partitionBy("experiment").orderBy(F.desc(rank_by), "model")
    return board.withColumn("position", F.row_number().over(order)).orderBy("experiment", "position")


def best_model(board: DataFrame) -> DataFrame:
    """First row of every experiment."""
    return board.where(F.col("position") == 1).drop("position")


def board_view(board: DataFrame, metrics=("balanced_accuracy", "macro_f1", "roc_auc"), top: int = 5) -> DataFrame:
    """The first rows of every experiment with a few metrics."""
    return board.where(F.col("position") <= top).select(*KEYS, "position", *metrics)


def headline(board: DataFrame, experiment: str, n_rows: int, n_used: int) -> DataFrame:
    """Best model of an experiment with its two main scores, and the data size before and after sampling."""
    best = best_model(board).where(F.col("experiment") == experiment)
    percent = F.format_string("%.2f%%", F.round(F.col("balanced_accuracy") * 100, 2))
    return best.select(
        "model",
        percent.alias("balanced_accuracy"),
        "roc_auc",
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.lit(n_used).cast("bigint").alias("n_used"),
    )


def leakage_drop(board: DataFrame, full: str, reduced: str) -> DataFrame:
    """Best of one experiment against best of the other, metric by metric."""
    best = best_model(board)
    metrics = [c for c in ("accuracy", "balanced_accuracy", "recall", "roc_auc") if c in board.columns]
    sides = []
    for experiment, suffix in ((full, "full"), (reduced, "reduced")):
        side = best.where(F.col("experiment") == experiment)
        cast = [F.col(m).alias(m) for m in metrics]
        sides.append(
            side.select(F.col("model"), *cast).unpivot(["model"], metrics, "metric", f"{suffix}_value")
            .withColumnRenamed("model", f"{suffix}_model")
        )
    return (
        sides[0]
        .join(sides[1], "metric")
        .withColumn("drop", F.round(F.col("full_value") - F.col("reduced_value"), DIGITS))
    )


def side_by_side(board: DataFrame, left: str, right: str, metrics, top: int | None = None) -> DataFrame:
    """The same model in two experiments, in one row."""
    def side(experiment: str, suffix: str) -> DataFrame:
        rows = board.where(F.col("experiment") == experiment)
        return rows.select(
            "model",
            F.col("position").alias(f"position_{suffix}"),
            *[F.col(m).alias(f"{m}_{suffix}") for m in metrics],
        )

    joined = side(left, "left").join(side(right, "right"), "model", "full")
    if top is not None:
        joined = joined.where((F.col("position_left") <= top) | (F.col("position_right") <= top))
    return joined.withColumns(
        {f"{m}_change": F.round(F.col(f"{m}_left") - F.col(f"{m}_right"), DIGITS) for m in metrics}
    )


def metrics_long(board: DataFrame, metrics=("macro_precision", "macro_recall", "macro_f1")) -> DataFrame:
    """Bar data: one row per model and metric."""
    return long_form(board, list(KEYS), metrics, "metric", "score")


def axis_minimum(board: DataFrame, metric: str = "accuracy", margin: float = 0.05) -> DataFrame:
    """Lower axis limit of a metric bar chart."""
    low = F.greatest(F.min(metric) - F.lit(margin), F.lit(0.0))
    return board.groupBy("experiment").agg(F.round(low, DIGITS).alias("axis_min"))


def classification_report(predictions: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Per-class, macro and weighted precision, recall, F1 and support, long."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    per_class = {
        0: (ratio(tn, tn + fn, 0.0), ratio(tn, tn + fp, 0.0), ratio(tn * 2, tn * 2 + fn + fp, 0.0), tn + fp),
        1: (ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0), ratio(tp * 2, tp * 2 + fp + fn, 0.0), tp + fn),
    }
    n = tp + fp + tn + fn

    def row(name, values, support):
        fields = [F.round(v, DIGITS).alias(c) for c, v in zip(("precision", "recall", "f1"), values)]
        return F.struct(F.lit(name).alias("label"), *fields, support.alias("support"))

    def weighted(i):
        return ratio(per_class[0][i] * per_class[0][3] + per_class[1][i] * per_class[1][3], n)

    accuracy = ratio(tp + tn, n)
    macro = [(per_class[0][i] + per_class[1][i]) / 2 for i in range(3)]
    lines = [row(labels[k], per_class[k][:3], per_class[k][3]) for k in (0, 1)]
    lines.append(row("accuracy", (F.lit(None).cast("double"), F.lit(None).cast("double"), accuracy), n))
    lines.append(row("macro avg", macro, n))
    lines.append(row("weighted avg", [weighted(i) for i in range(3)], n))
    counts = confusion_counts(predictions)
    return counts.select(*KEYS, F.explode(F.array(*lines)).alias("r")).select(*KEYS, "r.*")


def fold_scores(predictions: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """Mean and population deviation of a metric over folds; needs a ``fold`` column."""
    counts = confusion_counts(predictions, (*KEYS, "fold"))
    scored = counts.withColumn("score", metric_columns()[metric])
    return scored.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.round(F.avg("score"), DIGITS).alias("mean_score"),
        F.round(F.stddev_pop("score"), DIGITS).alias("std_score"),
    )


def threshold_table(predictions: DataFrame, thresholds=THRESHOLDS, names=("balanced_accuracy", "macro_f1")) -> DataFrame:
    """Metrics at every threshold from one pass over the rows.

    Each row falls in one band between thresholds; the counts of the few bands
    are then added from the top down.
    """
    bands = len(thresholds) + 1
    band = steps_passed(F.col("p"), thresholds)
    per_band = predictions.groupBy(*KEYS, band.alias("_band")).agg(
        count_where(F.col("y") == 1).alias("_pos"), count_where(F.col("y") == 0).alias("_neg")
    )
    sides = per_band.groupBy(*KEYS).agg(
        *[
            F.array(
                *[
                    F.coalesce(F.sum(F.when(F.col("_band") == b, F.col(side))), F.lit(0).cast("bigint"))
                    for b in range(bands)
                ]
            ).alias(side)
            for side in ("_pos", "_neg")
        ]
    )

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)

    # Threshold i (from 0) is passed by the bands above i.
    step = F.posexplode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("_i", "threshold")
    grid = sides.select(*KEYS, "_pos", "_neg", step)
    above, below = (lambda c: F.slice(c, F.col("_i") + 2, F.lit(bands))), (lambda c: F.slice(c, 1, F.col("_i") + 1))
    counts = grid.select(
        *KEYS,
        "threshold",
        total(above("_pos")).alias("tp"),
        total(above("_neg")).alias("fp"),
        total(below("_neg")).alias("tn"),
        total(below("_pos")).alias("fn"),
    )
    return score_counts(counts, list(names)).drop("tp", "fp", "tn", "fn")


def best_threshold(table: DataFrame) -> DataFrame:
    """Per model the first threshold with the highest rounded macro F1."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("macro_f1"), "threshold")
    return table.withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") == 1).drop("_pos")


def metrics_at(predictions: DataFrame, threshold: float) -> DataFrame:
    """Metrics when positives are the rows with p >= threshold."""
    names = ("balanced_accuracy", "precision", "recall", "macro_f1")
    return threshold_table(predictions, (threshold,), names)


def error_rows(predictions: DataFrame, cohort: DataFrame, id_col: str) -> DataFrame:
    """False positives and false negatives with their features."""
    marked = predictions.withColumn("quadrant", quadrant(F.col("y"), F.col("yhat")))
    wrong = marked.where(F.col("quadrant").isin("FP", "FN"))
    return wrong.join(cohort.withColumnRenamed(id_col, "row_id"), "row_id")


def error_patterns(scored: DataFrame, columns) -> DataFrame:
    """Percent deviation of the mean of FP and FN rows from the overall mean.

    ``scored`` holds y, yhat and the feature columns of one model.  A kind of
    error that does not occur gives no rows.
    """
    cell = quadrant(F.col("y"), F.col("yhat"))
    kinds = ("FP", "FN")
    aggs = []
    for c in columns:
        value = F.col(c).cast("double")
        aggs.append(F.avg(value).alias(f"all_{c}"))
        aggs += [F.avg(F.when(cell == k, value)).alias(f"{k}_{c}") for k in kinds]
    wide = scored.agg(*aggs)
    rows = [
        F.struct(
            F.lit(k).alias("quadrant"),
            F.lit(c).alias("feature"),
            F.round(
                (F.col(f"{k}_{c}") - F.col(f"all_{c}")) / (F.abs(F.col(f"all_{c}")) + F.lit(1e-9)) * 100, 4
            ).alias("deviation_percent"),
        )
        for k in kinds
        for c in columns
    ]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.where(F.col("deviation_percent").isNotNull())


def shuffled_label_check(predictions: DataFrame, seed=42) -> DataFrame:
    """Balanced accuracy against labels dealt out at random among the rows.

    Labels and predictions are put in two different hash orders and matched by
    position, which is a permutation of the labels.
    """
    keys = list(KEYS)
    base = materialize(predictions.select(*keys, "row_id", "y", "yhat"), "labels")
    n = base.count()
    digits = 2 if n < 10_000_000 else 4
    # A task's memory stays the same however long the table is.
    tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / ROWS_PER_SORT))
    left = hash_rank(base.drop("y"), "row_id", f"{seed}a", keys, "_pos", digits, tasks).drop("row_id")
    right = hash_rank(base.drop("yhat"), "row_id", f"{seed}b", keys, "_pos", digits, tasks).drop("row_id")
    left, right = (side.repartition(tasks, *keys, "_pos") for side in (left, right))
    paired = left.join(right, [*keys, "_pos"])
    return score_counts(confusion_counts(paired), ["balanced_accuracy"]).select(
        *keys, F.col("balanced_accuracy").alias("shuffled_balanced_accuracy")
    )


def stability_summary(scores: DataFrame, limit: float = 0.02) -> DataFrame:
    """Mean and deviation of a ``score`` column per model; stable below ``limit``."""
    out = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s")
    )
    return out.select(
        "model",
        "n_runs",
        F.round("_m", DIGITS).alias("mean_score"),
        F.round("_s", DIGITS).alias("std_score"),
        (F.col("_s") < limit).cast("int").alias("stable"),
    )


def named_classes(predictions: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Predictions with display names for true and predicted class."""
    return predictions.withColumns(
        {"true_label": relabel(F.col("y"), labels), "predicted_label": relabel(F.col("yhat"), labels)}
    )

"""Curves and areas over the scores of the predictions table.

Scores are first reduced to one row per distinct value; running totals over
those rows then give every curve exactly, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.expressions import count_where, ratio, steps_passed
from cohortlab.functions.ordering import running_totals
from cohortlab.operators.metrics import KEYS
from cohortlab.session import materialize

CALIBRATION_BINS = 10
RISK_BINS = 30
DIGITS = 6


def score_counts_by_value(predictions: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, kept as a table for the curve passes."""
    counts = predictions.groupBy(*KEYS, "p").agg(
        count_where(F.col("y") == 1).alias("pos"), count_where(F.col("y") == 0).alias("neg")
    )
    return materialize(counts, "scores")


def class_totals(by_value: DataFrame) -> DataFrame:
    """Positives and negatives per model: one row per model."""
    return by_value.groupBy(*KEYS).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_auc(by_value: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic; ties count half."""
    cum = running_totals(by_value, KEYS, "p", ["neg"])
    below = (F.col("cum_neg") - F.col("neg")).cast("double") + F.col("neg").cast("double") / 2
    sums = cum.groupBy(*KEYS).agg(
        F.sum(F.col("pos").cast("double") * below).alias("_wins"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
    )
    area = ratio(F.col("_wins"), F.col("_p") * F.col("_n"))
    return sums.select(*KEYS, F.round(area, digits).alias("roc_auc"))


def average_precision(by_value: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Sum over the distinct scores, from the top, of recall step times precision."""
    cum = running_totals(by_value, KEYS, "p", ["pos", "neg"], descending=True)
    precision = F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = cum.groupBy(*KEYS).agg(
        F.sum(F.col("pos").cast("double") * precision).alias("_s"), F.sum("pos").alias("_p")
    )
    return sums.select(*KEYS, F.round(ratio(F.col("_s"), F.col("_p")), digits).alias("average_precision"))


def roc_curve(by_value: DataFrame, drop_collinear: bool = False) -> DataFrame:
    """ROC points by descending threshold, starting from (0, 0) with no threshold.

    ``drop_collinear`` leaves out inner points whose step equals the next one,
    since a line through the neighbours already contains them.
    """
    totals = class_totals(by_value)
    cum = running_totals(by_value, KEYS, "p", ["pos", "neg"], descending=True, keep_bucket=True)
    if drop_collinear:
        cum = _without_repeated_steps(cum)
    # ``totals`` has one row per model.
    points = cum.join(F.broadcast(totals), list(KEYS)).select(
        *KEYS,
        F.col("p").alias("threshold"),
        F.round(ratio(F.col("cum_neg"), F.col("n_neg")), DIGITS).alias("fpr"),
        F.round(ratio(F.col("cum_pos"), F.col("n_pos")), DIGITS).alias("tpr"),
    )
    start = totals.select(
        *KEYS,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def _without_repeated_steps(cum: DataFrame) -> DataFrame:
    """Drop points whose (pos, neg) step equals the step of the next lower score.

    The next point of a bucket's last row is the first row of the next bucket,
    which is looked up in the table of first rows (one row per bucket).
    """
    keys = list(KEYS)
    step = F.struct("pos", "neg")
    first = cum.groupBy(*keys, "_bucket").agg(F.max_by(step, "p").alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    following = first.select(*keys, "_bucket", F.lead("_first").over(across).alias("_next_first"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("p"))
    nxt = F.coalesce(F.lead(step).over(inside), F.col("_next_first"))
    marked = cum.join(following, [*keys, "_bucket"]).withColumn("_next", nxt)
    return marked.where(F.col("_next").isNull() | (F.col("_next") != step)).drop("_next", "_next_first")


def pr_curve(by_value: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, ending at recall 0, precision 1."""
    totals = class_totals(by_value)
    cum = running_totals(by_value, KEYS, "p", ["pos", "neg"], descending=True)
    # ``totals`` has one row per model.
    points = cum.join(F.broadcast(totals), list(KEYS)).select(
        *KEYS,
        F.col("p").alias("threshold"),
        F.round(ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), DIGITS).alias("precision"),
        F.round(ratio(F.col("cum_pos"), F.col("n_pos")), DIGITS).alias("recall"),
    )
    end = totals.select(
        *KEYS,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def calibration_curve(predictions: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean predicted against observed share per bin; inner edges belong to the lower bin.

    The sum is rounded instead of the mean, so that the order of addition cannot
    show in the result.
    """
    bin_no = steps_passed(F.col("p"), [i / bins for i in range(1, bins)], strict=True) + 1
    return predictions.groupBy(*KEYS, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.round(F.sum("p"), DIGITS) / F.count(F.lit(1))).alias("mean_predicted"),
        (F.sum("y") / F.count(F.lit(1))).alias("fraction_positive"),
    )


def risk_histogram(predictions: DataFrame, bins: int = RISK_BINS) -> DataFrame:
    """Rows per equal-width score bin over [0, 1]."""
    bin_no = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(*KEYS, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentile_of(requests: DataFrame, population: DataFrame, id_col: str) -> DataFrame:
    """Percent of the population with a strictly lower score, for every request.

    Both tables need a score ``p``.  The counts below each distinct score are
    running totals; requests then look up their own score.
    """
    asked = requests.select("p").withColumn("n", F.lit(0))
    known = population.select("p").withColumn("n", F.lit(1))
    by_value = materialize(known.unionByName(asked).groupBy("p").agg(F.sum("n").alias("n")), "cdf")
    everything = by_value.agg(F.sum("n")).first()[0] or 0
    cum = running_totals(by_value, [], "p", ["n"])
    below = cum.select("p", (F.col("cum_n") - F.col("n")).alias("n_below"))
    percent = ratio(F.col("n_below") * 100, F.lit(everything))
    return requests.select(id_col, "p").join(below, "p").select(
        id_col,
        "p",
        F.round(percent, 4).alias("percentile"),
        F.round(F.lit(100.0) - percent, 4).alias("top_percent"),
    )

"""Audit of a cohort: sizes, nulls, class balance, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.expressions import count_where, long_form, ratio, relabel


def profile(df: DataFrame) -> DataFrame:
    """Row count, column count and the null count of the whole table, in one pass."""
    nulls = [F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.coalesce(total, F.lit(0)).alias("n_nulls"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column, long."""
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "n_nulls")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, most frequent first."""
    return (
        df.groupBy(F.col(column).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category")
    )


def class_shares(df: DataFrame, target: str, labels: dict[int, str]) -> DataFrame:
    """Rows and percent per class, with display names."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # One row per class.
    joined = counts.withColumn("n_all", F.sum("n").over(Window.partitionBy()))
    return joined.select(
        target,
        relabel(F.col(target), labels).alias("label"),
        "n",
        F.round(ratio(F.col("n") * 100, F.col("n_all")), 4).alias("percent"),
    ).orderBy(F.desc("n"), target)


def prevalence(df: DataFrame, target: str) -> DataFrame:
    """Negative and positive counts and the percent of positives."""
    return df.agg(
        count_where(F.col(target) == 0).alias("n_neg"),
        count_where(F.col(target) == 1).alias("n_pos"),
        F.round(F.avg(F.col(target)) * 100, 4).alias("positive_percent"),
    )


def majority_baseline(df: DataFrame, target: str) -> DataFrame:
    """Scores of the rule that always predicts the larger class."""
    counts = df.agg(
        count_where(F.col(target) == 0).alias("n_neg"), count_where(F.col(target) == 1).alias("n_pos")
    )
    top = F.greatest("n_neg", "n_pos")
    total = F.col("n_neg") + F.col("n_pos")
    classes = (F.col("n_neg") > 0).cast("int") + (F.col("n_pos") > 0).cast("int")
    f1 = ratio(top * 2, top * 2 + (total - top))
    return counts.select(
        F.when(F.col("n_pos") >= F.col("n_neg"), 1).otherwise(0).alias("majority_class"),
        F.round(ratio(top, total), 4).alias("accuracy"),
        F.round(ratio(F.lit(1.0), classes), 4).alias("balanced_accuracy"),
        F.round(f1 / classes, 4).alias("macro_f1"),
    )


def leakage_screen(df: DataFrame, spec) -> DataFrame:
    """Correlation of every numeric feature with the target, leakage columns marked."""
    features = [c for c in spec.features if c in spec.numeric_columns(df)]
    y = F.col(spec.target).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in features])
    long = long_form(wide, [], features, "feature", "corr")
    corr = F.when(F.isnan("corr"), None).otherwise(F.col("corr"))
    return long.select(
        "feature",
        F.col("feature").isin(list(spec.leakage)).cast("int").alias("is_leakage"),
        F.round(corr, 6).alias("corr_target"),
    )

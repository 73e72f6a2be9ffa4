"""Encoding, scaling and class weights, fitted on one table and applied to any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.expressions import count_where, ratio

MAX_CATEGORIES = 100_000


def encode_labels(df: DataFrame, columns, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace string columns by the index of the value in sorted order, from 0.

    The values come from ``fit_on`` (``df`` itself by default).  An unseen or null
    value raises an error when the result is computed.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    indexed = [f"_{c}_index" for c in columns]
    indexer = StringIndexer(
        inputCols=columns, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="error"
    )
    fitted = indexer.fit((df if fit_on is None else fit_on).select(*columns))
    # The categories travel to every task.
    if max(len(labels) for labels in fitted.labelsArray) > MAX_CATEGORIES:
        raise ValueError(f"a column of {columns} has more than {MAX_CATEGORIES} categories")
    out = fitted.transform(df)
    codes = dict(zip(columns, indexed))
    return out.select(*[F.col(codes[c]).cast("int").alias(c) if c in codes else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column."""

    means: dict[str, float]
    stds: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns) -> Scaler:
        """Fit in one pass; a column whose values are all equal gets a divisor of 1."""
        aggs = []
        for c in columns:
            value = F.col(c).cast("double")
            aggs.append(F.avg(value).alias(f"m_{c}"))
            varies = F.min(value) < F.max(value)
            aggs.append(F.when(varies, F.stddev_pop(value)).otherwise(0.0).alias(f"s_{c}"))
        row = df.agg(*aggs).first()
        return Scaler(
            {c: row[f"m_{c}"] for c in columns},
            {c: row[f"s_{c}"] or 1.0 for c in columns},
        )

    def rounded(self, digits: int) -> Scaler:
        """The same scaler with short numbers, for results that two engines must order alike."""
        return Scaler(
            {c: round(m, digits) for c, m in self.means.items()},
            {c: round(s, digits) or 1.0 for c, s in self.stds.items()},
        )

    def scaled(self, column: str) -> Column:
        return self.scaled_value(column, F.col(column).cast("double"))

    def scaled_value(self, column: str, value: Column) -> Column:
        """``value`` on the scale of a fitted column."""
        return (value - F.lit(self.means[column])) / F.lit(self.stds[column])

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Scale the fitted columns; with a prefix, beside the raw ones."""
        return df.withColumns({f"{prefix}{c}": self.scaled(c) for c in self.means})


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Per class: rows, balanced weight n/(k*n_c), and the positive-class weight."""
    counts = df.agg(
        count_where(F.col(target) == 0).alias("n_neg"), count_where(F.col(target) == 1).alias("n_pos")
    )
    n_neg, n_pos = F.col("n_neg"), F.col("n_pos")
    classes = (n_neg > 0).cast("int") + (n_pos > 0).cast("int")
    per_class = F.explode(
        F.array(
            F.struct(F.lit(0).alias(target), n_neg.alias("n")),
            F.struct(F.lit(1).alias(target), n_pos.alias("n")),
        )
    )
    pos_weight = ratio(n_neg, F.greatest(n_pos, F.lit(1)))
    exploded = counts.select(
        (n_neg + n_pos).alias("total"), classes.alias("k"), pos_weight.alias("pw"), per_class.alias("c")
    )
    return exploded.where(F.col("c.n") > 0).select(
        F.col(f"c.{target}").alias(target),
        F.col("c.n").alias("n"),
        F.round(ratio(F.col("total"), F.col("k") * F.col("c.n")), 6).alias("balanced_weight"),
        F.round(F.when(F.col(f"c.{target}") == 1, F.col("pw")).otherwise(1.0), 6).alias("pos_weight"),
    )


def class_counts(df: DataFrame, target: str) -> tuple[int, int]:
    """(negatives, positives)."""
    row = df.agg(
        F.coalesce(count_where(F.col(target) == 0), F.lit(0)).alias("n"),
        F.coalesce(count_where(F.col(target) == 1), F.lit(0)).alias("p"),
    ).first()
    return row["n"], row["p"]


def balanced_weight_column(target: str, n_neg: int, n_pos: int) -> Column:
    """Row weight n/(k*n_c)."""
    total, classes = n_neg + n_pos, (n_neg > 0) + (n_pos > 0)
    neg = total / (classes * n_neg) if n_neg else 1.0
    pos = total / (classes * n_pos) if n_pos else 1.0
    return F.when(F.col(target) == 1, F.lit(pos)).otherwise(F.lit(neg))


def positive_weight_column(target: str, n_neg: int, n_pos: int) -> Column:
    """Row weight n_neg/n_pos on positives, 1 on negatives."""
    return F.when(F.col(target) == 1, F.lit(n_neg / max(n_pos, 1))).otherwise(F.lit(1.0))

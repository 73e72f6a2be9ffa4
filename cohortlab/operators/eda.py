"""Exploratory aggregates: histograms, variance, correlation, box statistics."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.expressions import count_where, equal_width_bin, long_form, ratio
from cohortlab.functions.ordering import bracketed_quantiles, per_value

HISTOGRAM_BINS = 25
TOP_VARIANCE = 20
DIRECTION_ENDS = 8
WHISKER_REACH = 1.5


def histogram_by_class(df: DataFrame, target: str, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over each class's own range, with counts and percent of the class."""
    per_class = df.groupBy(target).agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n_class")
    )
    # One row per class.
    placed = df.select(target, column).join(F.broadcast(per_class), target)
    bin_no = equal_width_bin(F.col(column), F.col("low"), F.col("high"), bins)
    counted = placed.groupBy(target, bin_no.alias("bin"), "low", "high", "n_class").agg(
        F.count(F.lit(1)).alias("n")
    )
    width = (F.col("high") - F.col("low")).cast("double") / bins
    return counted.select(
        target,
        "bin",
        F.round(F.col("low") + F.col("bin") * width, 6).alias("bin_low"),
        "n",
        F.round(ratio(F.col("n") * 100, F.col("n_class")), 4).alias("percent_of_class"),
    )


def shared_histogram(df: DataFrame, target: str, column: str, width: float) -> DataFrame:
    """Fixed-width bins shared by the classes, as percent within the class."""
    counted = df.groupBy(target, F.floor(F.col(column) / F.lit(width)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counted = counted.withColumn("n_class", F.sum("n").over(Window.partitionBy(target)))
    return counted.select(
        target,
        "bin",
        "n",
        F.round(ratio(F.col("n") * 100, F.col("n_class")), 4).alias("percent_of_class"),
    )


def variance_ranking(df: DataFrame, columns, top: int = TOP_VARIANCE) -> DataFrame:
    """Columns with the largest sample variance, in one pass over the data."""
    wide = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns])
    long = long_form(wide, [], columns, "feature", "variance")
    # One row per column.
    order = Window.partitionBy().orderBy(F.desc("variance"), "feature")
    return (
        long.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("feature", "rank", F.round(F.sqrt("variance"), 4).alias("std_dev"))
    )


def correlation_lower(df: DataFrame, columns) -> DataFrame:
    """Pearson correlations below the diagonal; a constant column gives null."""
    columns = list(columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="error").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    )
    matrix = Correlation.corr(vectors.select("_v"), "_v").first()[0].toArray()
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[:i]):
            r = float(matrix[i][j])
            rows.append((a, b, None if r != r else r))
    schema = T.StructType(
        [
            T.StructField("feature_a", T.StringType()),
            T.StructField("feature_b", T.StringType()),
            T.StructField("r", T.DoubleType()),
        ]
    )
    pairs = df.sparkSession.createDataFrame(rows, schema)
    return pairs.withColumn("r", F.round("r", 6))


def box_statistics(df: DataFrame, target: str, columns) -> DataFrame:
    """Per feature and class: extremes, exact quartiles, whiskers and outlier count.

    Reads ``df`` four times, so it should be cheap to read; rows are shuffled only where they lie next to a quartile. Nulls
    don't count, NaN ends the job, a class without values of a feature has no row.
    """
    columns = [c for c in columns if c in df.columns]
    names = ("minimum", "q1", "median", "q3", "maximum")
    boxes = bracketed_quantiles(df, target, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})

    def numbers(c: str, name: str, kind: str = "double") -> Column:
        return per_value(target, {g: box[name] for (g, f), box in boxes.items() if f == c}, kind)

    aggs = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        reach = F.lit(WHISKER_REACH) * (numbers(c, "q3") - numbers(c, "q1"))
        inside = (value >= numbers(c, "q1") - reach) & (value <= numbers(c, "q3") + reach)
        aggs += [F.min(F.when(inside, value)).alias(f"_low{i}"), F.max(F.when(inside, value)).alias(f"_high{i}")]
        aggs.append(F.sum(F.when(inside | value.isNull(), 0).otherwise(1)).alias(f"_out{i}"))
    reached = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            numbers(c, "n", "bigint").alias("n"),
            *[F.round(numbers(c, name), 4).alias(name) for name in names],
            F.round(f"_low{i}", 4).alias("whisker_low"),
            F.round(f"_high{i}", 4).alias("whisker_high"),
            F.col(f"_out{i}").alias("n_outliers"),
        )
        for i, c in enumerate(columns)
    ]
    long = reached.select(target, F.explode(F.array(*parts)).alias("_b")).where(F.col("_b.n") > 0)
    fields = ("n", *names, "whisker_low", "whisker_high", "n_outliers")
    return long.select(F.col("_b.feature").alias("feature"), target, *[F.col(f"_b.{f}").alias(f) for f in fields])


def feature_direction(df: DataFrame, target: str, columns, ends: int = DIRECTION_ENDS) -> DataFrame:
    """Mean of the positives minus mean of the negatives: the lowest and highest features."""
    y = F.col(target)
    wide = df.agg(
        *[
            (
                F.avg(F.when(y == 1, F.col(c).cast("double"))) - F.avg(F.when(y == 0, F.col(c).cast("double")))
            ).alias(c)
            for c in columns
        ]
    )
    long = long_form(wide, [], columns, "feature", "mean_difference")
    up = Window.partitionBy().orderBy("mean_difference", "feature")
    down = Window.partitionBy().orderBy(F.desc("mean_difference"), F.desc("feature"))
    ranked = long.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    return ranked.where((F.col("_up") <= ends) | (F.col("_down") <= ends)).select(
        "feature", F.round("mean_difference", 4).alias("mean_difference")
    )


def column_means(df: DataFrame, columns) -> DataFrame:
    """Mean of every column, long."""
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return long_form(wide, [], columns, "feature", "mean").select(
        "feature", F.round("mean", 6).alias("mean")
    )


def mean_values(df: DataFrame, columns, digits: int = 6) -> dict[str, float]:
    """Column means as numbers, one row to the driver."""
    row = df.agg(*[F.round(F.avg(F.col(c).cast("double")), digits).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def class_row_counts(df: DataFrame, target: str) -> DataFrame:
    """Bar data of the class counts."""
    return df.agg(
        count_where(F.col(target) == 0).alias("n_neg"), count_where(F.col(target) == 1).alias("n_pos")
    )

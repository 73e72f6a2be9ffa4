"""Cohorts over the order tables, documents and embeddings.

They play the part of the patient table: one row per subject, a binary target
with a rare class, some columns that give the target away, some noise.
Money is kept in integer cents, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.sources.tables import read_table
from cohortlab.spec import CohortSpec

ORDER_GROSS_LIMIT_CENTS = 6_000_000

ORDERS = CohortSpec(
    id_col="row_id",
    target="target",
    features=(
        "n_lines",
        "gross_cents",
        "max_line_cents",
        "qty",
        "disc_pts",
        "tax_pts",
        "any_return",
        "total_cents",
        "acctbal_cents",
        "c_nationkey",
        "o_orderpriority",
    ),
    categorical=("o_orderpriority",),
    drop=("o_custkey",),
    leakage=("gross_cents", "max_line_cents"),
    groups={
        "Volume": ("n_lines", "qty"),
        "Pricing": ("disc_pts", "tax_pts", "total_cents"),
        "Customer": ("acctbal_cents", "c_nationkey"),
        "Service": ("any_return", "o_orderpriority"),
    },
    shifts={
        "n_lines": 1.0,
        "qty": -20.0,
        "disc_pts": -5.0,
        "tax_pts": -5.0,
        "acctbal_cents": 100000.0,
    },
    bounds={
        "n_lines": (1.0, 8.0),
        "qty": (5.0, 250.0),
        "disc_pts": (0.0, 45.0),
        "tax_pts": (0.0, 40.0),
        "total_cents": (100000.0, 45000000.0),
        "acctbal_cents": (0.0, 950000.0),
    },
    labels={0: "Regular (0)", 1: "Large (1)"},
)

VECTOR_DIMS = 64
VECTORS = CohortSpec(
    id_col="vec_id",
    target="target",
    features=tuple(f"e{i}" for i in range(VECTOR_DIMS)),
)

DOCUMENTS = CohortSpec(
    id_col="doc_id",
    target="target",
    features=("n_chars", "toxic", "n_digits", "n_lines", "n_spaces", "lang"),
    categorical=("lang",),
    drop=("source",),
)


def cents(col) -> F.Column:
    """``round(col * 100)``, halves away from zero, without the decimal text that ``round`` makes of every double."""
    value = col * 100
    near = F.rint(value)  # halves to even
    off = value - near
    away = F.when((off == 0.5) & (value > 0), near + 1).when((off == -0.5) & (value < 0), near - 1)
    return away.otherwise(near).cast("bigint")


def _line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(cents(F.col("l_extendedprice"))).alias("gross_cents"),
            F.max(cents(F.col("l_extendedprice"))).alias("max_line_cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
            F.sum(cents(F.col("l_discount"))).alias("disc_pts"),
            F.sum(cents(F.col("l_tax"))).alias("tax_pts"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("any_return"),
        )
    )


def _join_orders(spark: SparkSession, sf_dir: str, orders: DataFrame, how: str) -> DataFrame:
    lines = _line_features(spark, sf_dir)
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), how)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("row_id"),
            "o_custkey",
            "o_orderpriority",
            "n_lines",
            "gross_cents",
            "max_line_cents",
            "qty",
            "disc_pts",
            "tax_pts",
            "any_return",
            cents(F.col("o_totalprice")).alias("total_cents"),
            cents(F.col("c_acctbal")).alias("acctbal_cents"),
            "c_nationkey",
        )
    )


def order_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with line items; target 1 when the gross value is large."""
    orders = read_table(spark, sf_dir, "orders")
    target = F.when(F.col("gross_cents") >= ORDER_GROSS_LIMIT_CENTS, 1).otherwise(0)
    return _join_orders(spark, sf_dir, orders, "inner").withColumn("target", target)


def order_requests(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Every order as a subject to score, without the leakage columns.

    Orders whose line items are not entered yet have nulls in the line
    features, as an incompletely filled form would.
    """
    source = read_table(spark, sf_dir, "orders") if orders is None else orders
    return _join_orders(spark, sf_dir, source, "left").drop(*ORDERS.leakage, *ORDERS.drop)


def vector_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64 numeric features; label 0 is the rare class."""
    vectors = read_table(spark, sf_dir, "embeddings")
    dims = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(VECTOR_DIMS)]
    target = F.when(F.col("label") != 0, 1).otherwise(0).alias("target")
    return vectors.select("vec_id", target, *dims)


def document_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; the target is the quality label."""
    text = F.col("text")

    def removed(pattern: str) -> F.Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        removed("[0-9]").cast("bigint").alias("n_digits"),
        removed("\n").cast("bigint").alias("n_lines"),
        removed(" ").cast("bigint").alias("n_spaces"),
    )
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", "toxic", F.col("quality").alias("target")
    )
    return docs.join(labels, "doc_id")

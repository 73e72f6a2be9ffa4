"""Stratified samples, splits and folds.

A draw is fixed by (seed, row id) alone: rows are ordered by an md5 key, so the
result does not change with partitioning, retries or file layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.ordering import hash_rank, stratified_take

DEFAULT_SEED = 42
DEFAULT_SAMPLE = 5000
DEFAULT_TEST_SHARE = 0.2
DEFAULT_FOLDS = 5


def stratified_sample(df: DataFrame, spec, n: int = DEFAULT_SAMPLE, seed=DEFAULT_SEED) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), classes in proportion."""
    marked = stratified_take(df, spec.id_col, spec.target, seed, F.lit(n), "_in_sample")
    return marked.where("_in_sample").drop("_in_sample")


def stratified_split(
    df: DataFrame, spec, test_share: float = DEFAULT_TEST_SHARE, seed=DEFAULT_SEED
) -> DataFrame:
    """Add ``split``: ceil(test_share * n) rows are 'test', the others 'train'."""
    total = F.ceil(F.lit(test_share) * F.col("n_all"))
    marked = stratified_take(df, spec.id_col, spec.target, seed, total, "_in_test")
    name = F.when(F.col("_in_test"), "test").otherwise("train")
    return marked.withColumn("split", name).drop("_in_test")


def stratified_folds(df: DataFrame, spec, folds: int = DEFAULT_FOLDS, seed=DEFAULT_SEED) -> DataFrame:
    """Add ``fold`` 0..folds-1, dealt out class by class in hash order."""
    ranked = hash_rank(df, spec.id_col, seed, [spec.target], "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def repeated_splits(
    df: DataFrame, spec, runs: int = 5, test_share: float = DEFAULT_TEST_SHARE, seed: int = DEFAULT_SEED
) -> DataFrame:
    """One stratified split per run, stacked, with a ``run`` column."""
    parts = [
        stratified_split(df, spec, test_share, seed + run).withColumn("run", F.lit(run))
        for run in range(runs)
    ]
    return reduce(DataFrame.unionByName, parts)

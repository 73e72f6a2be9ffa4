"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import materialize, scratch_path

__all__ = ["ascii_lower", "columns_of", "drop_path", "materialize", "quoted", "read", "rebatch", "rows_of", "runs", "scratch_path"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows_of(docs: DataFrame, id_col: str, **columns: Column) -> DataFrame:
    """``doc_id`` and the given expressions of ``docs``, under names that no other column can clash with."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(n) for n, c in columns.items()))


def quoted(name: str) -> str:
    """A column's name as Spark reads it literally, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def text_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def partitions_for(amount: float, per_task: float, least: int = 1) -> int:
    return max(least, math.ceil(amount / per_task))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later read needs."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rebatch(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Arrow batches joined to tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole runs of equal ``key``; the input is sorted by it."""
    held: pa.Table | None = None
    for table in rebatch(batches, rows):
        held = table if held is None else pa.concat_tables([held, table])
        keys = held[key].combine_chunks().to_numpy(zero_copy_only=False)
        cut = int((keys == keys[-1]).argmax()) if keys[0] != keys[-1] else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()

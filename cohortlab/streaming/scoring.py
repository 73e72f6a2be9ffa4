"""Stateless scoring of arriving subjects with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlab.operators.services import assess, fill_missing
from cohortlab.session import scratch_path


def read_requests_stream(
    spark: SparkSession, folder: str, schema: T.StructType, file_glob: str = "*.parquet", max_files: int = 100
) -> DataFrame:
    """Parquet files arriving in a folder, with a declared schema."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def score_stream(
    requests: DataFrame,
    means: dict[str, float],
    score: Callable[[DataFrame], DataFrame],
    threshold: float = 0.5,
) -> DataFrame:
    """Fill, score and assess; the same plan serves batch and streaming tables."""
    return assess(score(fill_missing(requests, means)), threshold)


def run_to_table(scored: DataFrame, path: str | None = None, checkpoint: str | None = None) -> str:
    """Process everything that has arrived and append it to a parquet folder."""
    spark = scored.sparkSession
    path = path or scratch_path(spark, "scored")
    query = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def run_batches(scored: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hand each micro-batch to ``handle``, for services that need a join with the population."""
    query = (
        scored.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch_path(scored.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

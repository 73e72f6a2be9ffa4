"""Table readers and result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlab.session import scratch_root


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_cohort_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """CSV scan with a declared schema and a header row.

    Columns are matched by name: the files may hold more columns than the schema
    or another order, but a declared column that is absent raises an error, and so
    does a file whose header differs from that of the others.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    declared = {f.name: f.dataType for f in schema.fields}
    file_schema = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header])
    reader = spark.read.schema(file_schema).option("header", True).option("mode", mode)
    df = reader.option("enforceSchema", False).csv(path)  # every file's header is checked
    return df.select(*[f.name for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """Results table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Results table as parquet, optionally partitioned."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_reports(df: DataFrame, path: str) -> None:
    """Report records as JSON, one folder per risk level."""
    df.write.mode("overwrite").partitionBy("level").json(path)


class RunCache:
    """Results of expensive runs, kept as tables keyed by the run's settings.

    The first call for a key computes and writes the table; later calls, also
    from another job with the same root, read it.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{scratch_root(spark)}/runs"

    def path(self, name: str, **key) -> str:
        parts = "/".join(f"{k}={key[k]}" for k in sorted(key))
        return f"{self.root}/{name}/{parts}" if parts else f"{self.root}/{name}"

    def _complete(self, path: str) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(hadoop_path)

    def get(self, name: str, build: Callable[[], DataFrame], **key) -> DataFrame:
        path = self.path(name, **key)
        if not self._complete(path):
            write_parquet(build(), path)
        return self.spark.read.parquet(path)

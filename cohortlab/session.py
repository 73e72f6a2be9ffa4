"""Session settings and shared scratch storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING = threading.Lock()
_WRITERS: dict[str, tuple[int, str | None]] = {}  # by application: writes under way, the setting before them


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "cohortlab") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Has the effect of submitting the job with ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cohortlab-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master may go
    without it, since only there is a temporary folder visible to every task.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH_ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            shared = tempfile.mkdtemp(prefix="cohortlab-")
        _SCRATCH_ROOTS[app] = f"{shared.rstrip('/')}/{app}"
    return _SCRATCH_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Used where an intermediate result feeds several jobs: the lineage is cut by
    a table that outlives any executor, and later reads still prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun here delete their shuffle files when they end, instead of keeping them until the driver collects garbage.

    Several threads may be inside at once; the setting of the session is put back by the last one to leave.
    """
    app = spark.sparkContext.applicationId
    with _CLEANING:
        inside, before = _WRITERS.get(app, (0, None))
        if not inside:
            before = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _WRITERS[app] = inside + 1, before
    try:
        yield
    finally:
        with _CLEANING:
            inside, before = _WRITERS[app]
            _WRITERS[app] = inside - 1, before
            if inside == 1 and before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            elif inside == 1:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Delete the files of a table from ``materialize`` that no later read needs; of any other table nothing."""
    spark = table.sparkSession
    root = f"{scratch_root(spark)}/"
    jvm = spark._jvm
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        if f"{target.toUri().getPath()}/".startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"):
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Give a small table the task count that suits costly work per row.

    Partitions follow bytes by default, which leaves a small table in one task
    however long its rows take, or an iterative job with more tasks than it can
    use.  Tables that already fill the cluster's cores keep their partitions.
    """
    want = 1 + df.count() // rows_per_task
    have = df.rdd.getNumPartitions()
    if have > want:
        return df.coalesce(want)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(want, cores)) if have < min(want, cores) else df

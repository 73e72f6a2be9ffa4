"""Scratch tables leave nothing on disk that no later job reads."""

import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlab.session import SHUFFLE_CLEANUP, discard, materialize, scratch_root, shuffles_dropped


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_dropped(spark):
    before = shuffle_files(spark)
    counted = spark.range(20000).groupBy((F.col("id") % 997).alias("k")).count()
    table = materialize(counted, "counted")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == counted.count() == 997  # the query itself can still be run


def test_setting_is_put_back_by_the_last_writer(spark):
    was = spark.conf.get(SHUFFLE_CLEANUP, None)

    def write(i):
        return materialize(spark.range(i), "many").count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(write, range(12))) == list(range(12))
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == was
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
        1 / 0
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == was


def test_only_scratch_tables_are_discarded(spark, tmp_path):
    table = materialize(spark.range(10), "gone")
    (folder,) = {Path(f.removeprefix("file:")).parent for f in table.inputFiles()}
    assert str(folder).startswith(scratch_root(spark)) and folder.exists()
    discard(table)
    assert not folder.exists()
    spark.range(10).write.parquet(f"{tmp_path}/own")
    own = spark.read.parquet(f"{tmp_path}/own")
    discard(own)
    assert own.count() == 10

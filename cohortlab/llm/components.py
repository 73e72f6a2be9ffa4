"""Connected components of a table of links, by repeated star contraction.

Each round links every node's larger neighbours to its least neighbour, then the smaller ones
to the least (large-star and small-star); links never grow in number and the least node of a
component is the centre of a star after a logarithmic number of rounds.  A round is a partial
aggregation and a join on the node, whose hot keys adaptive execution can split.  Only counts
reach the driver.

Before each round the tasks replace blocks of their links by stars with the same components, which
takes no shuffle and leaves at most one link a node and block.  A table of at most ``BLOCK`` links is
settled by that alone; larger tables are dealt over as many more tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import drop_path, partitions_for, rebatch, scratch_path

BLOCK = 100_000  # links that a task contracts at once


def _written(links: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(links.sparkSession, "links")
    links.write.parquet(path)
    return links.sparkSession.read.parquet(path), path


def _contract(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of links replaced by links of each of their nodes to the least node it reaches in the block."""
    for table in rebatch(batches, block):
        up: dict[int, int] = {}

        def root(node: int) -> int:
            least = node
            while (above := up.setdefault(least, least)) != least:  # noqa: B023
                least = above
            while node != least:
                up[node], node = least, up[node]  # noqa: B023
            return least

        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        nodes = [node for node in up if root(node) != node]
        stars = [pa.array(nodes, pa.int64()), pa.array([root(node) for node in nodes], pa.int64())]
        yield pa.RecordBatch.from_arrays(stars, names=["a", "b"])


def _contracted(links: DataFrame, n: int) -> DataFrame:
    block = BLOCK
    return links.coalesce(partitions_for(n, block)).mapInArrow(lambda batches: _contract(batches, block), "a long, b long")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    near = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return near.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node of the links (a, b)."""
    links, path = _written(links.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())

    before = mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after, new_path = _written(_contracted(links, before[0]))
        drop_path(links.sparkSession, path)
        links, path = after, new_path
        if before[0] <= BLOCK:
            break
        after, new_path = _written(_small_star(_large_star(links)).distinct())
        drop_path(links.sparkSession, path)
        links, path = after, new_path
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

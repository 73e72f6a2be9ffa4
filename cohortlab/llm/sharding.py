"""Sharding into shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, id, row), so equal texts lie together and a text
that a third of all rows share can still be divided.  A size-weighted sample of these keys
gives quantile boundaries; every record falls in the range between two boundaries, and ranges
that turn out overfull are subdivided with further samples.  Exact positions are running sums
inside a range on top of the exact totals of the ranges before it, and the shards are cut from
these positions, so the shards' sizes are exact although the splitters are sampled.

Records larger than 1/HEAVY of the table are at most HEAVY in number; they are placed first,
largest onto the least full shard, and the ranges fill up what is left of each shard.  Shards
then differ by less than two such fractions of the table (and at least one record where a
single record is larger than a shard).

Defined cases: a null text has size 1 and the checksum of no bytes; null ids and repeated rows
are records like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import materialize, partitions_for, rows_of, text_of

HEAVY = 4096
ROWS_PER_RANGE = 20_000
LEAST_RANGES = 256
SAMPLES_PER_RANGE = 8
OVERFULL = 4.0
ROUNDS = 4

_KEY = [("h", np.int64), ("doc_id", np.int64), ("row", np.int64)]


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of the records' ids, sizes, checksums and keys."""
    text = text_of(docs, text_col)
    return materialize(
        rows_of(
            docs,
            id_col,
            size=F.octet_length(text).cast("long") + 1,
            text_crc32=F.crc32(text.cast("binary")),
            h=F.xxhash64(text),
            row=F.monotonically_increasing_id(),
        ),
        "records",
    )


def place_heavy(sizes: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], np.ndarray]:
    """Shard of each (row, size), largest first onto the least full shard, and the bytes of each shard."""
    full = [(0, shard) for shard in range(shards)]
    placed, totals = {}, np.zeros(shards, dtype=np.int64)
    for row, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, shard = full[0]
        heapq.heapreplace(full, (held + size, shard))
        placed[row] = shard
        totals[shard] += size
    return placed, totals


def remaining(totals: np.ndarray, amount: int) -> np.ndarray:
    """How much of ``amount`` each shard takes so that the totals end as level as they can."""
    order = np.sort(totals).astype(float)
    for n in range(len(order), 0, -1):
        level = (amount + order[:n].sum()) / n
        if level >= order[n - 1]:
            break
    return np.maximum(0.0, level - totals)


def splitters(light: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Sorted boundaries of about ``ranges`` ranges of equal bytes.

    A record is drawn with a chance in proportion to its size, by a hash of its row number, so a
    task that runs again draws the same sample.  At most about SAMPLES_PER_RANGE keys a range
    reach the driver.
    """
    chance = F.col("size") * (SAMPLES_PER_RANGE * ranges / max(total, 1))
    drawn = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 40)) < chance * (1 << 40)
    sample = light.where(drawn).select("h", "doc_id", "row").toPandas()
    keys = np.sort(_keys(sample["h"], sample["doc_id"].fillna(-1), sample["row"]), order=["h", "doc_id", "row"])
    return np.unique(keys[SAMPLES_PER_RANGE // 2 :: SAMPLES_PER_RANGE])


def _keys(h, doc_id, row) -> np.ndarray:
    keys = np.empty(len(h), dtype=_KEY)
    keys["h"], keys["doc_id"], keys["row"] = h, doc_id, row
    return keys


def range_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of the range of each key: the number of boundaries at or below it."""
    out = np.searchsorted(bounds["h"], keys["h"], "left")
    last = np.searchsorted(bounds["h"], keys["h"], "right")
    for lo in np.unique(out[out < last]):  # boundaries inside one text
        tied = np.flatnonzero((out == lo) & (last > lo))
        same = bounds[lo : last[tied[0]]]
        for bound in same:
            k = keys[tied]
            above = (k["doc_id"] > bound["doc_id"]) | ((k["doc_id"] == bound["doc_id"]) & (k["row"] >= bound["row"]))
            out[tied] += above
    return out


def _assign(bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].fill_null(-1).to_numpy(zero_copy_only=False)
            keys = _keys(batch["h"].to_numpy(), ids, batch["row"].to_numpy())
            found = pa.array(range_of(keys, bounds).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "part"])

    return assign


def ranged(light: DataFrame, total: int, ranges: int) -> tuple[DataFrame, list]:
    """``light`` with its range, and the ranges' rows and bytes in order; overfull ranges are subdivided."""
    bounds = splitters(light, total, ranges)
    schema = T.StructType([*light.schema.fields, T.StructField("part", T.IntegerType())])
    per_range = total / ranges
    for left in range(ROUNDS, -1, -1):  # the statistics are always those of the last bounds
        found = light.mapInArrow(_assign(bounds), schema)
        stats = found.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).orderBy("part").collect()
        overfull = {r["part"]: r["bytes"] for r in stats if r["bytes"] > OVERFULL * per_range and r["rows"] > 1}
        if not overfull or not left:
            break
        inside = found.where(F.col("part").isin(list(overfull))).drop("part")
        held = sum(overfull.values())
        more = splitters(inside, held, partitions_for(held, per_range))
        wider = np.unique(np.concatenate([bounds, more]))
        if len(wider) == len(bounds):
            break
        bounds = wider
    return light.mapInArrow(_assign(bounds), schema), stats


def _cut(parts: np.ndarray, before: np.ndarray, ends: np.ndarray):
    """Shard of each record by the middle of its bytes in the order of all light records."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(parts, batch["part"].to_numpy())
            size = batch["size"].to_numpy()
            middle = before[at, 1] + batch["upto"].to_numpy() - size / 2
            shard = np.minimum(np.searchsorted(ends, middle, "right"), len(ends) - 1)
            columns = {
                "doc_id": batch["doc_id"],
                "size": batch["size"],
                "text_crc32": batch["text_crc32"],
                "shard": pa.array(shard.astype(np.int32)),
                "rank": pa.array(before[at, 0] + batch["nth"].to_numpy()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return cut


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    table = records(docs, id_col, text_col)
    spark = table.sparkSession
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    is_heavy = F.col("size") * HEAVY > total
    placed, totals = place_heavy([tuple(r) for r in table.where(is_heavy).select("row", "size").collect()], shards)
    taken = np.bincount(list(placed.values()), minlength=shards)
    slots, next_slot = [], [0] * shards
    for row, shard in sorted(placed.items()):
        slots.append((row, shard, next_slot[shard]))
        next_slot[shard] += 1
    heavy = table.join(F.broadcast(spark.createDataFrame(slots, "row long, shard int, slot long")), "row")

    light = table.where(~is_heavy)
    light_total = int(total - totals.sum())
    least = max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted, stats = ranged(light, light_total, partitions_for(n, ROWS_PER_RANGE, least))
    in_range = Window.partitionBy("part").orderBy("h", "doc_id", "row")
    placed_in = parted.select(
        "doc_id",
        "size",
        "text_crc32",
        "part",
        (F.row_number().over(in_range) - 1).cast("long").alias("nth"),
        F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    sums = np.array([[r["rows"], r["bytes"]] for r in stats], dtype=np.int64).reshape(-1, 2)
    before = np.cumsum(sums, axis=0) - sums
    ends = np.cumsum(remaining(totals, light_total))
    parts = np.array([r["part"] for r in stats], dtype=np.int32)
    cut = materialize(
        placed_in.mapInArrow(_cut(parts, before, ends), "doc_id long, size long, text_crc32 long, shard int, rank long"),
        "cut",
    )
    firsts = [(r["shard"], r["first"]) for r in cut.groupBy("shard").agg(F.min("rank").alias("first")).collect()]
    shift = F.broadcast(
        spark.createDataFrame([(s, int(taken[s]) - f) for s, f in firsts], "shard int, shift long")
    )
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    lights = cut.join(shift, "shard").withColumn("slot", F.col("rank") + F.col("shift"))
    return lights.select(columns).unionByName(heavy.select(columns))

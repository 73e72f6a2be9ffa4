"""Exact deduplication on a cuckoo-filter index of live digests.

A text's key is the SHA-256 of the text with A-Z lower-cased.  Keys fall into buckets by
their first bits, so buckets are even whatever the texts are.  A bucket has a cuckoo filter
(four 16-bit fingerprints a slot row, two candidate rows a key) in front of its content, the
keys themselves with their group: a key that misses the filter is new without a look at the
content, a hit is verified against it.  A filter that cannot place a key is doubled and
refilled from the stored keys.

Copies are summed within each Arrow batch before the shuffle, so a text that a third of all
rows share reaches its bucket as one row a batch.

Defined cases: a null text counts as empty, so null and empty texts are one group; rows with
a null id are grouped like others and stay only if the whole group has no id; of repeated
rows (same id and text) exactly one stays; an empty table gives an empty result; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import (
    ascii_lower,
    columns_of,
    materialize,
    partitions_for,
    quoted,
    rebatch,
    rows_of,
    scratch_path,
    text_of,
)

SLOTS = 4
MAX_KICKS = 200
KEYS_PER_BUCKET = 100_000
NO_ID = -(1 << 63)

_STORED, _REMOVE, _ADD = 0, 1, 2
_CONTENT = "bucket int, digest binary, keep_id long, keep_row long, group_size long, filter binary"
_CHANGE = "bucket int, op int, digest binary, keep_id long, keep_row long, group_size long"


class CuckooFilter:
    """Set of 64-bit keys that may answer yes wrongly, never no; keys can be removed again."""

    def __init__(self, n_rows: int = 256) -> None:
        self.table = np.zeros((n_rows, SLOTS), dtype=np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = keys & mask
        return mark, first, self._other(first, mark)

    def _other(self, row: np.ndarray, mark: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = (mark.astype(np.uint64) * np.uint64(0x5BD1E995C6A4A793)) >> np.uint64(20)
        return (row ^ step) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if some key found no place; the filter must then be rebuilt larger."""
        mark, row, other = self._places(keys)
        for turn in range(MAX_KICKS):
            for _ in range(2):
                left = self._settle(mark, row)
                mark, row, other = mark[left], other[left], row[left]
                if not len(mark):
                    return True
            # one key of each crowded row takes the place of another, which goes to its second row
            _, chosen = np.unique(row, return_index=True)
            victim = (mark[chosen].astype(np.int64) + turn) % SLOTS
            put = mark[chosen].copy()
            mark[chosen] = self.table[row[chosen], victim]
            self.table[row[chosen], victim] = put
            row[chosen], other[chosen] = self._other(row[chosen], mark[chosen]), row[chosen]
        return False

    def _settle(self, mark: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Put marks in free slots of their target rows; indexes of those without one."""
        order = np.argsort(target, kind="stable")
        rows = target[order]
        start = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
        free = self.table[rows] == 0
        nth = np.cumsum(free, axis=1) - 1
        fits = free & (nth == rank[:, None])
        done = fits.any(1)
        self.table[rows[done], fits[done].argmax(1)] = mark[order[done]]
        return np.sort(order[~done])

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        for mark, first, second in zip(*self._places(keys), strict=True):
            for row in (first, second):
                at = np.flatnonzero(self.table[row] == mark)
                if len(at):
                    self.table[row, at[0]] = 0
                    break


class Bucket:
    """The filter of one bucket and its content: digest -> [keep_id, keep_row, group_size]."""

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.content: dict[bytes, list[int]] = {}

    def load(self, digests: list[bytes], groups: list[list[int]], table: bytes) -> None:
        self.content.update(zip(digests, groups, strict=True))
        if table:
            self.filter.table = np.frombuffer(table, dtype=np.uint16).reshape(-1, SLOTS).copy()
        elif digests:
            self._insert_new(digests)

    def add(self, digests: list[bytes], groups: list[list[int]]) -> None:
        keys = _keys(digests)
        fresh: dict[bytes, list[int]] = {}  # not in the filter yet
        for digest, group, hit in zip(digests, groups, self.filter.contains(keys).tolist(), strict=True):
            known = (self.content if hit else fresh).get(digest)
            if known is None:
                self.content[digest] = fresh[digest] = group
            else:
                known[:2] = max(known[:2], group[:2])
                known[2] += group[2]
        if fresh:
            self._insert_new(list(fresh))

    def _insert_new(self, digests: list[bytes]) -> None:
        keys = _keys(digests)
        while not self.filter.add(keys):
            self.filter = CuckooFilter(2 * len(self.filter.table))
            keys = _keys(list(self.content))

    def remove(self, digests: list[bytes]) -> None:
        hits = self.filter.contains(_keys(digests)).tolist()
        gone = [d for d, hit in zip(digests, hits, strict=True) if hit and self.content.pop(d, None) is not None]
        if gone:
            self.filter.remove(_keys(gone))


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)[:, 3]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch."""
    for table in rebatch(batches, 10_000):
        rows = table.sort_by([("digest", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
        sums = rows.group_by("digest", use_threads=False).aggregate(
            [("bucket", "first"), ("doc_id", "last"), ("row", "last"), ("row", "count")]
        )
        n = sums.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                sums["bucket_first"].combine_chunks(),
                pa.array([_ADD] * n, pa.int32()),
                sums["digest"].combine_chunks(),
                sums["doc_id_last"].combine_chunks(),
                sums["row_last"].combine_chunks(),
                sums["row_count"].combine_chunks().cast(pa.int64()),
            ],
            names=["bucket", "op", "digest", "keep_id", "keep_row", "group_size"],
        )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply changes, sorted by (bucket, op), to the buckets of a partition; rows of the new content."""
    number, bucket = None, Bucket()
    for table in rebatch(batches, 20_000):
        numbers, ops = table["bucket"].to_numpy(), table["op"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (ops[1:] != ops[:-1])])
        for at, to in zip(edges, np.r_[edges[1:], len(numbers)], strict=True):
            if number is not None and numbers[at] != number:
                yield from _rows(number, bucket)
                bucket = Bucket()
            number = int(numbers[at])
            part = table.slice(at, to - at)
            digests = part["digest"].to_pylist()
            groups = [list(g) for g in zip(*(part[c].to_pylist() for c in ("keep_id", "keep_row", "group_size")), strict=True)]
            if ops[at] == _STORED:
                bucket.load(digests, groups, b"")
            elif ops[at] == _REMOVE:
                bucket.remove(digests)
            else:
                bucket.add(digests, groups)
    if number is not None:
        yield from _rows(number, bucket)


def _rows(number: int, bucket: Bucket) -> Iterator[pa.RecordBatch]:
    names = ["bucket", "digest", "keep_id", "keep_row", "group_size", "filter"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    digests, groups = list(bucket.content), list(bucket.content.values())
    for at in range(0, len(digests), 10_000):
        part = groups[at : at + 10_000]
        columns = [[number] * len(part), digests[at : at + 10_000], *map(list, zip(*part, strict=True)), [None] * len(part)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
    last = [[number], [None], [None], [None], [None], [bucket.filter.table.tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(last, types, strict=True)], names=names)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of doc_id, a row number and the text's digest."""
    keyed = rows_of(
        docs,
        id_col,
        row=F.monotonically_increasing_id(),
        digest=F.unhex(F.sha2(ascii_lower(text_of(docs, text_col)).cast("binary"), 256)),
    )
    return materialize(keyed, "digests")


class CuckooIndex:
    """Index of the digests of live documents, written to the shared folder generation by generation."""

    def __init__(self, spark: SparkSession, n_buckets: int) -> None:
        self.spark, self.n_buckets = spark, n_buckets
        self.members: DataFrame | None = None
        self.content: DataFrame | None = None

    @classmethod
    def build(cls, members: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> CuckooIndex:
        """Index of a table from ``digests``."""
        spark = members.sparkSession
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = cls(spark, partitions_for(members.count(), keys_per_bucket, least))
        index.members = members
        index._write(index._grouped(members))
        return index

    def _bucketed(self, frame: DataFrame) -> DataFrame:
        start = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
        return frame.withColumn("bucket", (start % self.n_buckets).cast("int"))

    def _grouped(self, members: DataFrame) -> DataFrame:
        keyed = self._bucketed(members).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        return keyed.select("bucket", "digest", "doc_id", "row").mapInArrow(_combine, _CHANGE)

    def _write(self, changes: DataFrame) -> None:
        dealt = changes.repartition(self.n_buckets, "bucket").sortWithinPartitions("bucket", "op")
        path = scratch_path(self.spark, "cuckoo")
        dealt.mapInArrow(_apply, _CONTENT).write.parquet(path)
        self.content = self.spark.read.parquet(path)

    def groups(self) -> DataFrame:
        """digest, keep_id, keep_row and group_size of every live digest."""
        return self.content.where("filter is null").select("digest", "keep_id", "keep_row", "group_size")

    def filters(self) -> DataFrame:
        return self.content.where("filter is not null").select("bucket", "filter")

    def _stored(self) -> DataFrame:
        stored = self.content.where("filter is null").withColumn("op", F.lit(_STORED))
        return stored.select("bucket", "op", "digest", "keep_id", "keep_row", "group_size")

    def insert(self, members: DataFrame) -> None:
        """Add documents (a table from ``digests``)."""
        top = self.members.agg(F.coalesce(F.max("row"), F.lit(-1))).first()[0]
        members = members.withColumn("row", F.col("row") + F.lit(top + 1))
        self._write(self._stored().unionByName(self._grouped(members)))
        self.members = materialize(self.members.unionByName(members), "members")

    def delete(self, doc_ids: DataFrame) -> None:
        """Take out all rows whose id is in the one column of ``doc_ids``; a group's next largest id then stays."""
        ids = doc_ids.toDF("doc_id").distinct()
        touched = self.members.join(ids, "doc_id", "left_semi").select("digest").distinct()
        rest = materialize(self.members.join(ids, "doc_id", "left_anti"), "members")
        again = self._grouped(rest.join(touched, "digest", "left_semi"))
        none = F.lit(None).cast("long")
        removed = self._bucketed(touched).select(
            "bucket",
            F.lit(_REMOVE).alias("op"),
            "digest",
            *(none.alias(c) for c in ("keep_id", "keep_row", "group_size")),
        )
        self._write(self._stored().unionByName(removed).unionByName(again))
        self.members = rest


def _resolved(members: DataFrame) -> DataFrame:
    """The members with their group and whether they stay."""
    found = members.join(CuckooIndex.build(members).groups(), "digest")
    return found.withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the largest id of a group stays."""
    return _resolved(digests(docs, id_col, text_col)).select(
        "doc_id",
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all their columns."""
    content = F.struct(*columns_of(docs)).alias("content")
    stored = materialize(
        docs.select(
            content,
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(ascii_lower(text_of(docs, text_col)).cast("binary"), 256)).alias("digest"),
        ),
        "rows",
    )
    members = stored.select(F.col(f"content.{quoted(id_col)}").cast("long").alias("doc_id"), "row", "digest")
    # written first, so that Spark knows its size and moves the texts only if it is large
    copies = materialize(_resolved(members).where("not kept").select("row"), "copies")
    return stored.join(copies, "row", "left_anti").select("content.*")

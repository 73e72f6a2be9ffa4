"""Near-duplicate documents by SetSketch bands, joint estimates and exact checks on full sets.

1. Every text becomes its set of five-word shingles (64-bit hashes) and 360 SetSketch registers.
   Equal sets are one class, so exact copies cost nothing further.
2. Registers make 60 bands of six.  Band keys that several classes share are buckets; at the
   similarity asked for, two sets miss each other in all bands about once in 10^5 cases, and far
   less often above it.  In a bucket pairs are estimated from their registers until a spanning
   forest of the promising ones is known, which alone leaves it: a class once reached is only
   compared with those not reached yet, so alike classes take few comparisons.  Larger buckets (more than
   BUCKET classes, which only alike documents make) leave a star.
3. The components of these links are candidate groups.  Their sets are read again from the texts,
   and each group is verified on full sets: pairs in order of their estimate, only if not linked yet.
4. A group too large for one task is dealt into chunks.  Chunks are verified inside, then the most
   linked members of all chunks among each other, and last the members outside the group's largest
   component against all chunks, block by block, so that no link across chunks is lost.
5. Components of the verified links are the result.

Estimates only skip pairs far below the threshold (five deviations).  No pair list of a group is
ever made, and hot classes, buckets and groups are pre-aggregated, starred or dealt into chunks.

Defined cases: null and empty texts have no shingles and are their own components; texts with fewer
than five words have one shingle; rows with a null id make no links and are kept; repeated rows are
one class, and each of them is kept if its id is the component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm import setsketch, textscan
from cohortlab.llm.common import materialize, rows_of, runs, scratch_path, text_of
from cohortlab.llm.components import components

PERCENT = 75
MARGIN = 5.0  # deviations that an estimate may fall short by
BUCKET = 1000  # classes of a bucket compared as one matrix
CHUNK = 1000  # classes of a group verified in one task
CHUNK_SHINGLES = 4_000_000
CENTRAL = 4  # members that a chunk sends to the comparison between chunks
BROADCAST_ROWS = 1_000_000

_SKETCHED = "doc_id long, n_shingles long, set_hash binary, registers binary"


def _near(registers: np.ndarray, sizes: np.ndarray, rows: np.ndarray, row: int) -> np.ndarray:
    """Estimated similarity of one set with others; 0 if their sizes rule a link out."""
    a, b = sizes[rows], sizes[row]
    fits = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
    out = np.zeros(len(rows))
    rows = rows[fits]
    if len(rows):
        other, own = registers[rows], registers[row]
        out[fits] = setsketch.estimate(
            (other > own).sum(1), (other < own).sum(1), sizes[rows].astype(float), float(b) * np.ones(len(rows)), len(own)
        )
    return out


def _cutoff() -> float:
    p = PERCENT / 100
    return p - MARGIN * np.sqrt(p * (1 - p) / setsketch.REGISTERS)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _promising(registers: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (left, right > left if both lists are the same) above the cutoff, likeliest first."""
    cutoff, same = _cutoff(), left is right
    firsts, seconds, scores = [], [], []
    for k, i in enumerate(left):
        others = right[k + 1 :] if same else right
        if not len(others):
            continue
        score = _near(registers, sizes, others, i)
        hit = score >= cutoff
        if hit.any():
            firsts.append(np.full(hit.sum(), i))
            seconds.append(others[hit])
            scores.append(score[hit])
    if not firsts:
        return []
    order = np.argsort(-np.concatenate(scores), kind="stable")
    return list(zip(np.concatenate(firsts)[order].tolist(), np.concatenate(seconds)[order].tolist(), strict=True))


def _spanning(registers: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """A spanning forest of the pairs of ``members`` above the cutoff: rows and, of each, the rows it reached."""
    cutoff, rows, reached = _cutoff(), [], []
    unseen, waiting = members, []
    while len(unseen):
        if not waiting:
            waiting, unseen = [int(unseen[0])], unseen[1:]
            continue
        row = waiting.pop()
        near = _near(registers, sizes, unseen, row) >= cutoff
        if near.any():
            rows.append(row)
            reached.append(unseen[near])
            waiting += unseen[near].tolist()
            unseen = unseen[~near]
    return rows, reached


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table of id, set size, set hash and registers of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textscan.text_bytes(batch["text"])
            words, at = textscan.word_hashes(data, offsets)
            sizes, hashes, registers = [], [], []
            for i in range(batch.num_rows):
                shingles = textscan.shingle_hashes(words[at[i] : at[i + 1]])
                sizes.append(len(shingles))
                hashes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                registers.append(setsketch.sketch(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "registers"],
            )

    rows = rows_of(docs, id_col, text=text_of(docs, text_col))
    return materialize(rows.mapInArrow(scan, _SKETCHED), "sketches")


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, setsketch.REGISTERS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            part = batch.slice(at, 5_000)
            if not part.num_rows:
                continue
            keys = setsketch.band_keys(_registers(part["registers"]))
            ids = np.repeat(part["node"].to_numpy(), setsketch.BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "node"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the promising pairs of each bucket; buckets are runs of equal key."""
    for table in runs(batches, "key"):
        keys, nodes = table["key"].to_numpy(), table["node"].to_numpy()
        sizes, registers = table["n_shingles"].to_numpy(), _registers(table["registers"])
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        length = np.diff(edges)
        pair = edges[:-1][length == 2]
        above = (registers[pair] > registers[pair + 1]).sum(1)
        below = (registers[pair] < registers[pair + 1]).sum(1)
        a, b = sizes[pair].astype(float), sizes[pair + 1].astype(float)
        fits = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
        if len(pair):
            fits &= setsketch.estimate(above, below, a, b, setsketch.REGISTERS) >= _cutoff()
        left, right = [nodes[pair[fits]]], [nodes[pair[fits] + 1]]
        for at, n in zip(edges[:-1][length > 2], length[length > 2], strict=True):
            for row, others in zip(*_spanning(registers, sizes, np.arange(at, at + n)), strict=True):
                left.append(np.full(len(others), nodes[row]))
                right.append(nodes[others])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _candidate_links(classes: DataFrame) -> DataFrame:
    """Links that connect all classes that may be alike, not yet verified."""
    spark = classes.sparkSession
    keyed = classes.select("node", "registers").mapInArrow(_keys, "key long, node long")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "shared")
    held = materialize(keyed.join(shared, "key"), "buckets")
    small = held.where(F.col("n") <= BUCKET).select("key", "node").join(classes, "node")
    dealt = small.select("key", "node", "n_shingles", "registers").repartition("key").sortWithinPartitions("key", "node")
    links = dealt.mapInArrow(_bucket_links, "a long, b long")
    stars = held.where(F.col("n") > BUCKET).select(F.col("node").alias("a"), F.col("least").alias("b")).where("a != b")
    path = scratch_path(spark, "candidates")
    links.unionByName(stars).distinct().write.parquet(path)
    return spark.read.parquet(path)


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts replaced by their shingle sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = textscan.text_bytes(batch["text"])
        words, at = textscan.word_hashes(data, offsets)
        sets = [textscan.shingle_hashes(words[at[i] : at[i + 1]]).tobytes() for i in range(batch.num_rows)]
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(sets, pa.binary())], names=[*others, "shingles"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) of each unit, and how many promising partners a member has (b null).

    A unit is a run of equal ``unit``.  Members of side 0 are compared with all, members of side 1
    only with those of side 0; pairs whose labels are equal are linked already.
    """
    for table in runs(batches, "unit", 2_000):
        units, side = table["unit"].to_numpy(), table["side"].to_numpy()
        nodes, labels = table["node"].to_numpy(), table["label"].to_numpy()
        raw = table["shingles"].to_pylist()
        edges = np.flatnonzero(np.r_[True, units[1:] != units[:-1], True])
        a, b, n = [], [], []
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in raw[at:to]]
            sizes = np.array([len(x) for x in sets])
            registers = np.stack([setsketch.sketch(x) for x in sets])
            own, ours = np.flatnonzero(side[at:to] == 0), np.flatnonzero(side[at:to] == 1)
            pairs = _promising(registers, sizes, own, own) + _promising(registers, sizes, own, ours)
            forest, degree = _Forest(to - at), np.zeros(to - at, dtype=np.int64)
            first: dict[int, int] = {}
            for i, label in enumerate(labels[at:to].tolist()):
                forest.join(i, first.setdefault(label, i))
            for i, j in pairs:
                degree[i] += 1
                degree[j] += 1
                if forest.root(i) != forest.root(j) and _linked(sets[i], sets[j]):
                    forest.join(i, j)
                    a.append(nodes[at + i])
                    b.append(nodes[at + j])
                    n.append(0)
            for i in np.argsort(-degree, kind="stable")[:CENTRAL]:
                a.append(nodes[at + i])
                b.append(None)
                n.append(int(degree[i]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "degree"]
        )


_VERIFIED = "a long, b long, degree long"


def _verified(members: DataFrame) -> DataFrame:
    """Written result of ``_verify`` for rows (unit, side, label, node, shingles)."""
    dealt = members.repartition("unit").sortWithinPartitions("unit", "side", "node")
    return materialize(dealt.mapInArrow(_verify, _VERIFIED), "verified")


def _sets_of(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``members`` with the shingle sets of their nodes (each node is the id of a document)."""
    few = members.count() <= BROADCAST_ROWS
    texts = rows_of(docs, id_col, text=text_of(docs, text_col)).withColumnRenamed("doc_id", "node")
    joined = texts.join(F.broadcast(members) if few else members, "node")
    schema = ", ".join(f"{n} {t}" for n, t in joined.drop("text").dtypes) + ", shingles binary"
    return joined.mapInArrow(_to_sets, schema)


def _near_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links that connect every group of near copies."""
    spark = docs.sparkSession
    groups = materialize(components(_candidate_links(classes)), "groups")
    sizes = groups.join(classes.select("node", "n_shingles"), "node").groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    members = groups.join(sizes, "component").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    members = materialize(members, "members")
    unit = F.xxhash64("component", "chunk")
    sets = _sets_of(docs, members, id_col, text_col).dropDuplicates(["node"])
    first = _verified(
        sets.select(unit.alias("unit"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "shingles")
    )
    links = first.where("b is not null").select("a", "b")
    large = members.where("chunks > 1")
    if not large.limit(1).count():
        return links

    # the most linked members of all chunks, among each other
    large_sets = materialize(_sets_of(docs, large, id_col, text_col).dropDuplicates(["node"]), "large")
    central = first.where("b is null and degree > 0").select(F.col("a").alias("node"))
    hubs = large_sets.join(central, "node", "left_semi").withColumn(
        "part", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("chunks") * CENTRAL / CHUNK)).cast("int")
    )
    second = _verified(
        hubs.select(
            F.xxhash64("component", "part", F.lit(7)).alias("unit"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "shingles"
        )
    )
    links = links.unionByName(second.where("b is not null").select("a", "b"))

    # members outside the largest component of their group, against all chunks
    found = components(links).withColumnRenamed("component", "label")
    labelled = large_sets.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialize(labelled, "labelled")
    counted = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    top = Window.partitionBy("component").orderBy(F.desc("n"), "label")
    main = counted.withColumn("place", F.row_number().over(top)).where("place = 1").select("component", F.col("label").alias("main"))
    rest = labelled.join(main, "component").where("label != main").drop("main")
    outside = rest.groupBy("component", "chunk").agg(F.count("*").alias("n")).select("component", F.col("chunk").alias("own"))
    pair = F.xxhash64("component", "own", "chunk")
    columns = ["node", "label", "shingles"]
    wide = rest.withColumn("own", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    ours = labelled.join(outside, "component")
    third = _verified(
        wide.select(pair.alias("unit"), F.lit(0).alias("side"), *columns).unionByName(
            ours.join(rest.select("node"), "node", "left_anti").select(pair.alias("unit"), F.lit(1).alias("side"), *columns)
        ).unionByName(
            rest.withColumnRenamed("chunk", "c").join(outside, "component").where("c != own").withColumnRenamed("c", "chunk")
            .select(pair.alias("unit"), F.lit(1).alias("side"), *columns)
        )
    )
    return materialize(links.unionByName(third.where("b is not null").select("a", "b")), "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sketches = _sketched(docs, id_col, text_col)
    classes = (
        sketches.where("set_hash is not null and doc_id is not null")
        .groupBy("set_hash")
        .agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c"))
        .select("set_hash", F.col("c.doc_id").alias("node"), "c.n_shingles", "c.registers")
    )
    classes = materialize(classes, "classes")
    links = _near_links(docs, classes.drop("set_hash"), id_col, text_col)
    found = components(links)
    named = classes.select("set_hash", "node").join(found, "node", "left")
    named = materialize(named.select("set_hash", F.coalesce("component", "node").alias("component_id")), "named")
    rows = sketches.select("doc_id", "n_shingles", "set_hash")
    full = rows.where("set_hash is not null").join(named, "set_hash", "left").drop("set_hash")
    empty = rows.where("set_hash is null").drop("set_hash").withColumn("component_id", F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return full.unionByName(empty).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their component; of repeated rows all stay."""
    dropped = near_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("w_dropped")).distinct()
    dropped = materialize(dropped, "dropped")  # Spark then knows its size and moves the texts only if it is large
    return docs.join(dropped, docs[id_col].cast("long") == dropped["w_dropped"], "left_anti")

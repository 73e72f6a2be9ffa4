"""Exact k-nearest-neighbour join by a nested partition tree.

No pairs of rows are ever emitted.  Points are put in the nodes of a space partition that is
``NODE_DEPTH`` cuts deep at each level and as many levels high as the table asks for; queries fall
into the same nodes.  A query first searches its own node, which bounds the distance of its k-th
neighbour.  Nodes of queries then meet nodes of points level by level: a pair of nodes lives on only if
their boxes come closer than the largest bound in the query node, so the table of visits holds two
node numbers and a bound and no features.  At the last level each query of the node is held against the
box once more, and the nodes that are left are searched as numpy blocks of bounded size.  A block is cut once more
inside its task, into leaves whose boxes rule out most of its points, so nodes can be large and a query meets few of
them.  The result is exact at any size, and only the cuts and boxes of the first level (at most 2^NODE_DEPTH) leave Spark.

Copies of the same vector are cut down to the few with the smallest ids, which
are the only ones that can be among the k nearest; a third of all rows being
identical therefore costs no more than one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.session import discard, materialize

NODE_ROWS = 16_384  # points per node aimed at
NODE_DEPTH = 10  # cuts between a node and its children, which are 2^NODE_DEPTH at most
BLOCK_POINTS = 50_000  # points searched as one block; larger nodes are several blocks
BLOCK_QUERIES = 16_000  # queries searched against one block
LEAF_ROWS = 128  # points per leaf aimed at, inside a block
LEAF_QUERIES = 32  # queries that search the leaves together
SAMPLE_ROWS = 16  # sampled points per node that place the cuts; they affect balance only
TILE = 500_000  # distances held at once; rows per step follow from it

_Q, _P = "_qid", "_pid"


def _grow_cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of every inner node of a binary space partition, level by level."""
    axis = np.zeros(2**depth - 1, dtype=np.int64)
    value = np.full(2**depth - 1, np.inf)
    members = {0: sample}
    for node in range(2**depth - 1):
        rows = members.pop(node, sample[:0])
        low = rows
        high = rows[:0]
        if len(rows) > 1:
            spread = rows.std(axis=0)
            a = int(spread.argmax())
            if spread[a] > 0:
                cut = float(np.median(rows[:, a]))
                if not (rows[:, a] > cut).any():
                    cut = float((rows[:, a].min() + rows[:, a].max()) / 2)
                axis[node], value[node] = a, cut
                right = rows[:, a] > cut
                low, high = rows[~right], rows[right]
        members[2 * node + 1], members[2 * node + 2] = low, high
    return axis, value


def _cell_of(x: np.ndarray, axis: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, axis[node]] > value[node])
    return node - (2**depth - 1)


def _nearest(
    q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray, same: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, point row and squared distance of the k nearest points within each query's bound.

    A matrix product gives all distances up to a known rounding error; only pairs
    that may still count are then computed exactly, adding the columns from left
    to right as SQL does.  Sorted by query, distance and point row.  ``same`` marks
    pairs to leave out.
    """
    q_norm, p_norm = (q * q).sum(axis=1), (p * p).sum(axis=1)
    rough = q_norm[:, None] + p_norm[None, :] - 2.0 * (q @ p.T)
    error = 8 * (q.shape[1] + 2) * np.finfo(float).eps * (q_norm + p_norm.max())
    if same is not None:
        rough[same] = np.inf
    limit = bound + error
    if len(p) > k and np.isinf(bound).any():
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error)
    row, col = np.nonzero((rough <= limit[:, None]) & (rough < np.inf))
    value = np.zeros(len(row))
    for j in range(q.shape[1]):
        diff = q[row, j] - p[col, j]
        value += diff * diff
    near = value <= bound[row]
    row, col, value = row[near], col[near], value[near]
    order = np.lexsort((col, value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], value[first]


def _box_pairs(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between every box of one set and every box of another."""
    least, most = np.zeros((len(low), len(lows))), np.zeros((len(low), len(lows)))
    for j in range(low.shape[1]):
        up, down = lows[None, :, j] - high[:, None, j], low[:, None, j] - highs[None, :, j]
        gap, reach = np.maximum(np.maximum(up, down), 0.0), np.maximum(-up, -down)
        least += gap * gap
        most += np.maximum(reach, gap) ** 2
    return least, most


def _search_leaves(
    q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray, q_ids: np.ndarray, p_ids: np.ndarray, exclude_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_nearest`` finds for all queries of a block, without meeting the points of far leaves; ``p`` is sorted by id."""
    depth = max(0, math.ceil(math.log2(max(1, len(p) / LEAF_ROWS))))
    axis, value = _grow_cuts(p[:: max(1, len(p) // (SAMPLE_ROWS * 2**depth))], depth)
    cell = _cell_of(p, axis, value, depth)
    order = np.argsort(cell, kind="stable")
    heads = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))
    leaves = np.split(order, heads[1:])
    lows, highs = np.minimum.reduceat(p[order], heads, axis=0), np.maximum.reduceat(p[order], heads, axis=0)

    def meet(rows: np.ndarray, chosen: np.ndarray, limit: np.ndarray):
        points = np.sort(np.concatenate([leaves[i] for i in chosen])) if len(chosen) < len(leaves) else np.arange(len(p))
        same = q_ids[rows, None] == p_ids[None, points] if exclude_self else None
        row, col, value = _nearest(q[rows], p[points], k, limit, same)
        return row, points[col], value

    found = []
    by_leaf = np.argsort(_cell_of(q, axis, value, depth), kind="stable")
    for rows in np.split(by_leaf, range(LEAF_QUERIES, len(q), LEAF_QUERIES)):
        least, _ = _box_pairs(q[rows], q[rows], lows, highs)
        limit = bound[rows]
        if np.isinf(limit).any() and len(leaves) > 1:
            row, _, value_here = meet(rows, np.unique(least.argmin(axis=1)), limit)
            last = np.flatnonzero(np.bincount(row, minlength=len(rows)) == k)
            limit = limit.copy()
            limit[last] = np.minimum(limit[last], value_here[np.searchsorted(row, last, side="right") - 1])
        chosen = np.flatnonzero((least <= limit[:, None]).any(axis=0))
        if len(chosen):
            row, col, value_here = meet(rows, chosen, limit)
            found.append((rows[row], col, value_here))
    if not found:
        return by_leaf[:0], by_leaf[:0], np.zeros(0)
    row, col, value = (np.concatenate(x) for x in zip(*found, strict=True))
    back = np.argsort(row, kind="stable")
    return row[back], col[back], value[back]


def _scan(asked: DataFrame, points: DataFrame, slices: DataFrame, features, carry, k: int, exclude_self: bool, blocks: int) -> DataFrame:
    """Search blocks: the rows of ``asked`` (with ``_node``, ``_chunk``, ``_bound``) against the points there.

    One row per row of ``asked`` with up to k candidates within its ``_bound``.  A block is (node,
    chunk of its points, slice of its visiting queries), so a node that attracts many queries is
    searched by several tasks; ``slices`` has the number of slices of each node.
    """
    left = asked.join(slices, "_node").withColumn("_slice", F.pmod(F.xxhash64(_Q), F.col("_slices")).cast("int"))
    right = points.join(slices, "_node").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    key = ["_node", "_chunk", "_slice"]

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by(_P)
        q, p = _matrix(asked, features), _matrix(known, features)
        row, col, value = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
        if len(p):
            q_ids, p_ids, bound = asked[_Q].to_numpy(), known[_P].to_numpy(), asked["_bound"].to_numpy()
            row, col, value = _search_leaves(q, p, k, bound, q_ids, p_ids, exclude_self)
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(q))))
        more = _matrix(known, carry)[col].ravel()
        lists = [
            pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
            for starts, values in (
                (ends, known[_P].combine_chunks().take(pa.array(col))),
                (ends, pa.array(value)),
                (ends * len(carry), pa.array(more, from_pandas=True)),
            )
        ]
        kept = asked.select([_Q, *features, "_node", "_chunk"])
        for name, column in zip(("_ids", "_d2", "_more"), lists, strict=True):
            kept = kept.append_column(name, column)
        return kept

    numbers = ", ".join(f"{f} double" for f in features)
    schema = f"{_Q} long, {numbers}, _node long, _chunk int, _ids array<long>, _d2 array<double>, _more array<double>"
    # The work grows with pairs, not bytes, so the task count is given explicitly:
    # adaptive execution would merge these small partitions into a few slow tasks.
    # ``blocks`` is how many there are at most.
    tasks = min(blocks, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = left.select(*key, _Q, "_bound", *features).repartition(tasks, *key)
    right = right.select(*key, _P, *features, *carry).repartition(tasks, *key)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def _matrix(rows: pa.Table, columns) -> np.ndarray:
    return np.array([rows[c].to_numpy() for c in columns], dtype=float).reshape(len(columns), rows.num_rows).T


def _vectors(df: DataFrame, id_col: str, id_name: str, features, carry=()) -> DataFrame:
    """Id and features as plain doubles; a null feature raises an error."""
    def strict(c: str):
        bad = F.raise_error(F.lit(f"null in feature {c} of a neighbour search")).cast("double")
        return F.coalesce(F.col(c).cast("double"), bad)

    cols = [strict(c).alias(f"_f{i}") for i, c in enumerate(features)]
    extra = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(carry)]
    return df.select(F.col(id_col).cast("bigint").alias(id_name), *cols, *extra)


class PartitionTree:
    """Nested space partition of a written table of points; a node's number is the path to it in bits."""

    def __init__(self, points: DataFrame, n: int, f_cols: list[str]) -> None:
        self.points, self.f_cols = points, f_cols
        total = max(0, math.ceil(math.log2(max(1, n / NODE_ROWS))))
        self.depths = [min(NODE_DEPTH, total)]
        while sum(self.depths) < total:
            self.depths.append(min(NODE_DEPTH, total - sum(self.depths)))
        sample = self._sample(points, n, self.depths[0]).select(*f_cols).toPandas().to_numpy(float)
        self.cuts = _grow_cuts(sample, self.depths[0])
        self.deeper: list[DataFrame] = []
        placed, above = self._first(points), []
        for level in range(1, len(self.depths)):
            placed = materialize(placed, "level")
            sampled = self._sample(placed, n, sum(self.depths[: level + 1])).select("_node", *f_cols)
            self.deeper.append(materialize(self._grown(sampled, self.depths[level]), "cuts"))
            above.append(placed)
            placed = self._next(placed, _P, level)
        placed = materialize(placed, "placed")
        for table in above:
            discard(table)
        boxes = [F.min(c).alias(f"lo{c}") for c in f_cols] + [F.max(c).alias(f"hi{c}") for c in f_cols]
        counted = placed.groupBy("_node").agg(F.count(F.lit(1)).alias("_rows"), *boxes)
        chunks = F.ceil(F.col("_rows") / BLOCK_POINTS).cast("int").alias("_chunks")
        self.nodes = materialize(counted.select("*", chunks), "nodes")
        chunk = F.pmod(F.xxhash64(_P), F.col("_chunks")).cast("int").alias("_chunk")
        self.blocks = placed.join(self.nodes.select("_node", "_chunks"), "_node").select(*placed.columns, chunk)

    @staticmethod
    def _sample(rows: DataFrame, n: int, depth: int) -> DataFrame:
        share = min(1.0, SAMPLE_ROWS * 2.0**depth / max(1, n))
        return rows if share == 1.0 else rows.sample(share, seed=7)

    def _first(self, rows: DataFrame) -> DataFrame:
        (axis, value), depth, f_cols = self.cuts, self.depths[0], self.f_cols

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(_node=_cell_of(pdf[f_cols].to_numpy(float), axis, value, depth))

        return rows.mapInPandas(place, T.StructType([*rows.schema.fields, T.StructField("_node", T.LongType())]))

    def _grown(self, sampled: DataFrame, depth: int) -> DataFrame:
        """The cuts below every node that has sampled points."""
        f_cols = self.f_cols

        def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
            axis, value = _grow_cuts(pdf[f_cols].to_numpy(float), depth)
            return pd.DataFrame({"_node": [key[0]], "_axis": [axis], "_value": [value]})

        return sampled.groupBy("_node").applyInPandas(grow, "_node long, _axis array<long>, _value array<double>")

    def _next(self, rows: DataFrame, id_col: str, level: int) -> DataFrame:
        """Rows moved from the nodes of a level to the children; nodes without cuts have one child."""
        depth, f_cols, columns = self.depths[level], self.f_cols, rows.columns
        parts = rows.groupBy("_node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).cast("int").alias("_parts"))
        parts = materialize(parts, "parts")
        left = rows.join(parts, "_node").withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int"))
        right = self.deeper[level - 1].join(parts, "_node")
        right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

        def place(pdf: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
            child = np.zeros(len(pdf), dtype=np.int64)
            if len(cuts):
                axis, value = np.asarray(cuts["_axis"].iloc[0]), np.asarray(cuts["_value"].iloc[0], dtype=float)
                child = _cell_of(pdf[f_cols].to_numpy(float), axis, value, depth)
            return pdf[columns].assign(_node=pdf["_node"].to_numpy() * 2**depth + child)

        key = ["_node", "_part"]
        left, right = left.drop("_parts"), right.drop("_parts")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(place, rows.schema)

    def place(self, rows: DataFrame, id_col: str) -> DataFrame:
        """Written ``rows`` with the node of the last level that each falls into, which may hold no points."""
        rows, above = self._first(rows), []
        for level in range(1, len(self.depths)):
            above.append(materialize(rows, "level"))
            rows = self._next(above[-1], id_col, level)
        rows = materialize(rows, "asked")
        for table in above:
            discard(table)
        return rows

    def boxes(self, level: int) -> DataFrame:
        """Nodes of a level with their number of points and their boxes."""
        below = sum(self.depths[level + 1 :])
        extremes = [F.min(f"lo{c}").alias(f"lo{c}") for c in self.f_cols] + [F.max(f"hi{c}").alias(f"hi{c}") for c in self.f_cols]
        return self.nodes.groupBy(F.shiftright("_node", below).alias("_node")).agg(F.sum("_rows").alias("_rows"), *extremes)

    def visits(self, asked: DataFrame, k: int) -> DataFrame:
        """Written table of _qnode, _node and _bound: the pairs of nodes that may hold a neighbour.

        ``asked`` holds the boxes of the query nodes and their ``_bound``, the largest distance at
        which a query of the node still looks for neighbours.
        """
        f_cols = self.f_cols
        lo, hi = [f"lo{c}" for c in f_cols], [f"hi{c}" for c in f_cols]
        top = self.boxes(0).orderBy("_node").toPandas()  # 2^NODE_DEPTH rows at most
        number, large = top["_node"].to_numpy(), top["_rows"].to_numpy() > k
        lows, highs = top[lo].to_numpy(float), top[hi].to_numpy(float)
        rows = max(1, TILE // max(1, len(top)))

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), rows):
                    part = pdf.iloc[start : start + rows]
                    least, most = _box_pairs(part[lo].to_numpy(float), part[hi].to_numpy(float), lows, highs)
                    bound = part["_bound"].to_numpy(float)
                    if large.any():  # a node of more than k points lies within its greatest distance
                        bound = np.minimum(bound, most[:, large].min(axis=1) * (1 + 1e-12))
                    row, col = np.nonzero(least <= bound[:, None])
                    yield pd.DataFrame({"_qnode": part["_qnode"].to_numpy()[row], "_node": number[col], "_bound": bound[row]})

        pairs = "_qnode long, _node long, _bound double"
        met = materialize(asked.mapInPandas(first, pairs), "visits")
        for level in range(1, len(self.depths)):
            met = materialize(self._children_met(met, asked, level, pairs), "visits")
        return met

    def _children_met(self, met: DataFrame, asked: DataFrame, level: int, pairs: str) -> DataFrame:
        """Pairs of query nodes and the children of the nodes they have met that come within the bound."""
        lo, hi = [f"lo{c}" for c in self.f_cols], [f"hi{c}" for c in self.f_cols]
        slices = met.groupBy("_node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_slices"))
        slices = materialize(slices.withColumnRenamed("_node", "_parent"), "slices")
        left = met.withColumnRenamed("_node", "_parent").join(asked.drop("_bound"), "_qnode").join(slices, "_parent")
        left = left.withColumn("_slice", F.pmod(F.xxhash64("_qnode"), F.col("_slices")).cast("int"))
        children = self.boxes(level).withColumn("_parent", F.shiftright("_node", self.depths[level]))
        right = children.join(slices, "_parent").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))

        def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            bound = q["_bound"].to_numpy(float)
            least, _ = _box_pairs(*(x[c].to_numpy(float) for x in (q, p) for c in (lo, hi)))
            row, col = np.nonzero(least <= bound[:, None])
            return pd.DataFrame({"_qnode": q["_qnode"].to_numpy()[row], "_node": p["_node"].to_numpy()[col], "_bound": bound[row]})

        key = ["_parent", "_slice"]
        left, right = left.drop("_slices"), right.drop("_slices")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, pairs)


def _narrowed(bounded: DataFrame, visits: DataFrame, counts: DataFrame, nodes: DataFrame, f_cols) -> DataFrame:
    """A row for each query and block whose box is within the query's own reach; blocks searched already are left out."""
    met = visits.groupBy("_qnode").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_parts"))
    sizes = met.join(counts.withColumnRenamed("_node", "_qnode"), "_qnode")
    sizes = materialize(sizes.withColumn("_slices", F.ceil(F.col("_asked") / BLOCK_QUERIES).cast("int")).drop("_asked"), "sizes")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = bounded.join(sizes, "_qnode").withColumn("_slice", F.pmod(F.xxhash64(_Q), F.col("_slices")).cast("int")).withColumn("_part", spread("_parts"))
    right = visits.join(nodes, "_node").join(sizes, "_qnode").withColumn("_part", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"))
    right = right.withColumn("_slice", spread("_slices"))
    lo, hi = [f"lo{c}" for c in f_cols], [f"hi{c}" for c in f_cols]

    def narrow(q: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        x, reach, home = q[f_cols].to_numpy(float), q["_reach"].to_numpy(float), q["_home"].to_numpy()
        low, high, bound = boxes[lo].to_numpy(float), boxes[hi].to_numpy(float), boxes["_bound"].to_numpy(float)
        number, chunks, own = boxes["_node"].to_numpy(), boxes["_chunks"].to_numpy(), boxes["_qnode"].to_numpy()
        out, step = [], max(1, TILE // max(1, len(boxes)))
        for start in range(0, len(x), step):
            part = slice(start, start + step)
            least, _ = _box_pairs(x[part], x[part], low, high)
            limit = np.minimum(reach[part, None], bound[None, :])
            row, col = np.nonzero(least <= limit)
            times = chunks[col]
            chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, col = np.repeat(row, times), np.repeat(col, times)
            new = (number[col] != own[col]) | (chunk != home[part][row])
            row, col, chunk = row[new], col[new], chunk[new]
            found = q.iloc[start + row][[_Q, *f_cols]]
            out.append(found.assign(_node=number[col], _chunk=chunk.astype("int32"), _bound=limit[row, col]))
        return pd.concat(out) if out else q[[_Q, *f_cols]].assign(_node=0, _chunk=0, _bound=0.0)

    key = ["_qnode", "_slice", "_part"]
    blocks = sizes.agg(F.coalesce(F.sum(F.col("_parts") * F.col("_slices")), F.lit(1))).first()[0]
    tasks = min(int(blocks), int(bounded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = left.select(*key, _Q, *f_cols, "_home", "_reach").repartition(tasks, *key)
    right = right.select(*key, "_node", "_bound", "_chunks", *lo, *hi).repartition(tasks, *key)
    numbers = ", ".join(f"{f} double" for f in f_cols)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(narrow, f"{_Q} long, {numbers}, _node long, _chunk int, _bound double")


def _search(asked: DataFrame, kept: DataFrame, n: int, f_cols, c_cols, k: int, exclude_self: bool) -> DataFrame:
    """Candidates of every query: those of its own node, then those of the nodes that its bound cannot rule out."""
    tree = PartitionTree(kept, n, f_cols)
    discard(kept)  # the tree holds its own copy
    placed = tree.place(asked, _Q)
    counts = materialize(placed.groupBy("_node").agg(F.count(F.lit(1)).alias("_asked")), "counts")
    sliced = lambda n: F.ceil(n / BLOCK_QUERIES).cast("int").alias("_slices")
    chunks = tree.nodes.select("_node", "_chunks")
    blocks = tree.nodes.agg(F.coalesce(F.sum("_chunks"), F.lit(0))).first()[0]

    def scan(visits: DataFrame, slices: DataFrame) -> DataFrame:
        slices = materialize(slices, "slices")
        more = slices.agg(F.coalesce(F.sum("_slices"), F.lit(0))).first()[0]
        return _scan(visits, tree.blocks, slices, f_cols, c_cols, k, exclude_self, int(blocks + more + 1))

    own = F.pmod(F.xxhash64(_Q, F.lit(1)), F.coalesce("_chunks", F.lit(1))).cast("int").alias("_chunk")
    home = placed.join(chunks, "_node", "left").select(*placed.columns, own, F.lit(float("inf")).alias("_bound"))
    near = scan(home, counts.select("_node", sliced(F.col("_asked"))))
    if blocks <= 1:
        return near
    near = materialize(near, "near")
    bound = F.when(F.size("_d2") == k, F.get("_d2", F.lit(k - 1))).otherwise(F.lit(float("inf")))
    bounded = near.select(_Q, *f_cols, F.col("_node").alias("_qnode"), F.col("_chunk").alias("_home"), bound.alias("_reach"))
    boxes = [F.min(c).alias(f"lo{c}") for c in f_cols] + [F.max(c).alias(f"hi{c}") for c in f_cols]
    query_nodes = materialize(bounded.groupBy("_qnode").agg(F.max("_reach").alias("_bound"), *boxes), "query_nodes")
    visits = tree.visits(query_nodes, k)
    # Written so that a node's points are copied for the queries that do visit it, not for all those of its visiting nodes.
    met = materialize(_narrowed(bounded, visits, counts, tree.nodes.drop("_rows"), f_cols), "met")
    visiting = met.groupBy("_node", "_chunk").agg(F.count(F.lit(1)).alias("_asked")).groupBy("_node")
    return near.unionByName(scan(met, visiting.agg(sliced(F.max("_asked")))))


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    features,
    k: int,
    query_id: str,
    point_id: str,
    exclude_self: bool = False,
    carry=(),
) -> DataFrame:
    """The k nearest points of every query by Euclidean distance, ties by point id.

    Returns ``query_id, neighbor_rank, neighbor_id, d2`` (squared distance) and
    one double column ``nn_<c>`` for every point column in ``carry``.
    """
    features, carry = list(features), list(carry)
    f_cols = [f"_f{i}" for i in range(len(features))]
    c_cols = [f"_c{i}" for i in range(len(carry))]

    copies = Window.partitionBy(*f_cols).orderBy(_P)
    kept = (
        _vectors(points, point_id, _P, features, carry)
        .withColumn("_copy", F.row_number().over(copies))
        .where(F.col("_copy") <= k + int(exclude_self))
        .drop("_copy")
    )
    kept = materialize(kept, "points")
    n = kept.count()
    asked = _vectors(queries, query_id, _Q, features)
    found = _search(asked, kept, n, f_cols, c_cols, k, exclude_self)

    width = len(carry)
    pairs = found.select(_Q, F.posexplode("_ids").alias("_i", "neighbor_id"), "_d2", "_more")
    flat = pairs.select(
        F.col(_Q).alias(query_id),
        "neighbor_id",
        F.col("_d2")[F.col("_i")].alias("d2"),
        *[F.col("_more")[F.col("_i") * width + i].alias(f"nn_{c}") for i, c in enumerate(carry)],
    )
    order = Window.partitionBy(query_id).orderBy("d2", "neighbor_id")
    ranked = flat.withColumn("neighbor_rank", F.row_number().over(order))
    return ranked.where(F.col("neighbor_rank") <= k)


def knn_vote(queries: DataFrame, points: DataFrame, features, k: int, id_col: str, target: str) -> DataFrame:
    """Share of positives among the k nearest points, and the majority vote."""
    near = knn_join(queries, points, features, k, id_col, id_col, carry=[target])
    votes = near.groupBy(id_col).agg(F.avg(f"nn_{target}").alias("p"))
    return votes.select(
        id_col, F.round("p", 6).alias("p"), (F.col("p") >= 0.5).cast("int").alias("yhat")
    )


def similar_subjects(
    requests: DataFrame,
    population: DataFrame,
    features,
    id_col: str,
    target: str,
    n: int = 5,
    scaler=None,
    show=(),
) -> DataFrame:
    """The n most similar known subjects of every request, with label and distance.

    Distances use the raw feature values; pass a ``Scaler`` to weigh all
    features alike.  ``show`` names population columns to list beside them.
    """
    shown = {c: f"_show_{c}" for c in show}
    population = population.withColumns({new: F.col(c) for c, new in shown.items()})
    if scaler is not None:
        requests, population = scaler.transform(requests), scaler.transform(population)
    near = knn_join(requests, population, features, n, id_col, id_col, carry=[target, *shown.values()])
    return near.select(
        id_col,
        "neighbor_rank",
        "neighbor_id",
        F.col(f"nn_{target}").cast("int").alias(f"neighbor_{target}"),
        F.round(F.sqrt("d2"), 2).alias("distance"),
        *[F.col(f"nn_{new}").alias(f"neighbor_{c}") for c, new in shown.items()],
    )


def similar_outcomes(similar: DataFrame, id_col: str, target: str) -> DataFrame:
    """How many of the similar subjects are positive, per request."""
    return similar.groupBy(id_col).agg(
        F.sum(f"neighbor_{target}").alias("n_positive"), F.count(F.lit(1)).alias("n_similar")
    )

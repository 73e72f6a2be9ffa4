"""Embedding whitening on MLlib block matrices.

Entries become whole numbers x = floor(64 c) + 1000000.  Count and sums of each dimension are exact;
rows centred by them are indexed into an ``IndexedRowMatrix`` and cut into distributed blocks.  The
transposed block matrix times the matrix gives the scatter, whose middle dimension is split over many
tasks; its eigenvectors are found locally (dimension by dimension in size), and the block matrix
times the whitening matrix projects all rows.  Spark notes the places of all blocks of a product on
the driver, so at most ``PANEL_BLOCKS`` blocks are multiplied at once: larger tables go panel by panel, with
scatters added up.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out, as are rows
of another length than the most frequent one (of equally frequent ones the longest).  Entries are held
within +-2^61.  Components without variance (eigenvalues lost in rounding) cannot be scaled to one and give no
rows, so a table of equal vectors gives none, as does an empty one.  Repeated rows count each time.  ``deviation`` is null
where it passes 64 bits; ``deviation_exact`` has it as a decimal of up to 38 digits.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_ENTRIES = 1 << 18
BLOCK_COLUMNS = 1024
PANEL_BLOCKS = 1 << 16
LIMIT = 1 << 61

_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows that have a whole vector."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    return rows.where(F.size("v") > 0).where(F.forall("v", finite))


def _indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """index (gapless), vec_id and x of the valid rows, and their count.

    A row's index is its rank in the file part that holds it plus the rows of all parts before.
    """
    held = lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)) + SHIFT
    numbered = rows.select(F.monotonically_increasing_id().alias("number"), "vec_id", F.transform("v", held).alias("x"))
    entries = materialize(numbered, "entries").withColumn("part", F.shiftright("number", 33))
    parts = materialize(entries.groupBy("part").agg(F.count("*").alias("rows"), F.min("number").alias("least")), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least")).alias("base"))
    total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    joined = entries.join(F.broadcast(bases), "part")  # one row for each task that wrote
    return joined.select((F.col("number") + F.col("base")).alias("index"), "vec_id", "x"), total


def _numbers(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def _blocks(rows: DataFrame, n_rows: int, width: int) -> BlockMatrix:
    """Block matrix of (index, v) rows; the rows stay in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("v")), "v")
    columns = min(width, BLOCK_COLUMNS)
    return IndexedRowMatrix(vectors, n_rows, width).toBlockMatrix(max(1, BLOCK_ENTRIES // columns), columns)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product whose middle dimension is split, so that a small result does not bring all blocks to one task."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(blocks: BlockMatrix, spark: SparkSession) -> np.ndarray:
    splits = min(blocks.numRowBlocks, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return _times(blocks.transpose(), blocks, max(1, splits)).toLocalMatrix().toArray()


def _local(matrix: np.ndarray, spark: SparkSession) -> BlockMatrix:
    """A small matrix as a block matrix whose rows are cut as the columns of the rows' blocks."""
    step, wide = min(matrix.shape[0], BLOCK_COLUMNS), matrix.shape[1]
    parts = [((i // step, 0), matrix[i : i + step]) for i in range(0, matrix.shape[0], step)]
    blocks = [(k, DenseMatrix(len(m), wide, m.flatten("F").tolist())) for k, m in parts]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), step, wide, *matrix.shape)


def _rows_of(product: BlockMatrix) -> DataFrame:
    """index and v of the rows of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.toDF("index", "vector").select("index", vector_to_array("vector").alias("v"))


def axes(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance that have variance, and the covariance's trace."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    floor = max(values[0], 0.0) * len(values) * 64 * np.finfo(float).eps
    k = min(components, int((values > floor).sum()))
    return values[:k], vectors[:, :k], float(np.trace(covariance))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_exact: a row for each vector and component."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], _RESULT)
    valid = _valid(vectors, id_col, vector_col)
    commonest = valid.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if commonest is None:
        return empty
    width = commonest["size"]
    indexed, n = _indexed(valid.where(F.size("v") == width))

    sums = indexed.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos")
    sums = [int(r["s"]) for r in sums.collect()]  # one row for each dimension
    whole = _numbers([s // n for s in sums], "long")
    rest = _numbers([(s % n) / n for s in sums], "double")
    centred = F.transform("x", lambda x, i: (x - F.get(whole, i)).cast("double") - F.get(rest, i))

    exact = "decimal(38,0)"
    totals = _numbers([str(s) for s in sums], exact)
    apart = lambda x, s: F.try_subtract(F.try_multiply(x.cast("decimal(20,0)"), F.lit(n).cast("decimal(18,0)")), s)
    squares = F.transform(F.zip_with("x", totals, apart), lambda d: F.try_multiply(d, d).cast(exact))
    deviation = F.aggregate(squares, F.lit(0).cast(exact), lambda a, d: F.try_add(a, d).cast(exact))

    block_rows = max(1, BLOCK_ENTRIES // min(width, BLOCK_COLUMNS))
    panel_rows = PANEL_BLOCKS * block_rows
    panels = []
    scatter = np.zeros((width, width))
    for start in range(0, n, panel_rows):
        stop = min(n, start + panel_rows)
        rows = indexed.where((F.col("index") >= start) & (F.col("index") < stop)).select((F.col("index") - start).alias("index"), centred.alias("v"))
        blocks = _blocks(rows, stop - start, width)
        scatter += _scatter(blocks, spark)
        panels.append((start, blocks))

    values, directions, trace = axes(scatter, n, components)
    if not len(values):
        return empty
    weights = _local(directions / np.sqrt(values), spark)
    second = np.zeros((len(values), len(values)))
    projected = None
    for start, blocks in panels:
        product = _times(blocks, weights, 1)
        second += _scatter(product, spark)
        part = _rows_of(product).withColumn("index", F.col("index") + start)
        projected = part if projected is None else projected.unionByName(part)
    projected = materialize(projected, "projected")
    means = projected.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos")
    means = np.array([r["m"] for r in means.collect()])  # one row for each component
    error = float(np.abs(second / n - np.outer(means, means) - np.eye(len(values))).max())

    shares = _numbers([float(v / trace) for v in values], "double")
    rows = indexed.select("index", "vec_id", deviation.alias("deviation_exact")).join(projected, "index")
    return rows.select("vec_id", "deviation_exact", F.posexplode("v").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation_exact as long)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
    )

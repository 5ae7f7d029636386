"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Vectors become whole numbers, so that sums and deviations are exact. The distinct ones are centred, indexed and cut into distributed blocks; the blocks' transpose
times the blocks is the scatter, whose eigenvectors the driver finds (a matrix as wide as a vector is long). The blocks times the
whitening matrix are the projected rows, and their own transpose times them says how close the result is to the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, Matrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import ranked
from .shared import work_path

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
# entries beyond this are no numbers that a long could hold after scaling and summing
LARGEST = 2.0**40
# rows of a block; more where there would be over MOST_BLOCKS of them, since the driver holds the place of each block
BLOCK_ROWS = 512
MOST_BLOCKS = 65_536
BLOCK_COLUMNS = 1024
PRODUCT_TASKS = 2_000

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): each entry c of a usable vector as floor(64 c) + 1000000."""
    v = F.col("embedding")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0)).filter(fits)
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def distributed(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """``n`` rows (position from 0, centred) as blocks, kept while they are multiplied.

    A block is put together by one shuffle of its rows as they are; ``IndexedRowMatrix.toBlockMatrix`` shuffles a pair of objects per entry.
    """
    tall, panel = max(BLOCK_ROWS, math.ceil(n / MOST_BLOCKS)), min(width, BLOCK_COLUMNS)

    def put_together(row) -> Iterator[tuple[tuple[int, int], Matrix]]:
        block = np.array([r["centred"] for r in sorted(row["rows"], key=lambda r: r["position"])])
        for at in range(0, width, panel):
            part = block[:, at : at + panel]
            yield (row["block"], at // panel), Matrices.dense(*part.shape, part.ravel(order="F"))

    gathered = rows.groupBy(F.floor(F.col("position") / tall).cast("int").alias("block")).agg(F.collect_list(F.struct("position", "centred")).alias("rows"))
    return BlockMatrix(gathered.rdd.flatMap(put_together), tall, panel, n, width).persist(StorageLevel.MEMORY_AND_DISK)


def own_product(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. The inner dimension is split over tasks, as the result is one block or a few; each task adds up its own first."""
    turned = blocks.transpose()._java_matrix_wrapper._java_model
    splits = min(PRODUCT_TASKS, max(1, blocks.numRowBlocks))
    product = turned.multiply(blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive. Those that are zero but for rounding are left out."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    there = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    use = np.flatnonzero(there)[:components]
    values, vectors = values[use], vectors[:, use]
    at = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[at, np.arange(len(use))])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Input: vec_id, embedding; other columns are ignored. Vectors that are null, empty or hold a null, a number that is not finite or one beyond 2**40 take no part, nor
    do vectors of another length than most (the smaller length on a tie): a covariance has one width. Each row of a repeated vec_id or vector comes out; the fit
    counts each distinct vector once. ``n`` is their number, ``deviation`` the sum over dimensions of (n x - S)**2, exact (null where a long can't hold it), ``explained`` the component's share
    of the trace, ``identity_error`` the largest absolute entry of the whitened vectors' covariance less the identity. Components without variance have no rows; an
    empty table, or one whose vectors are all equal, gives an empty result.

    To the driver come sums per dimension, matrices as wide as a vector is long, and one place per block, 65,536 at most.
    """
    spark = vectors.sparkSession

    def written(df: DataFrame, stem: str) -> DataFrame:
        path = work_path(spark, f"whitening-{stem}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = written(whole_numbers(vectors), "rows")
    size = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if size is None:
        return spark.createDataFrame([], SCHEMA)
    width = size["width"]
    rows = rows.filter(F.size("x") == width)
    fit = ranked(rows.select("x").distinct(), ["x"], "position").withColumn("position", F.col("position") - 1)
    n = fit.count()
    sums = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(19,0)")).alias("s"))
    total = [int(r["s"]) for r in sums.orderBy("pos").collect()]

    # n x - S is exact, and so is its quotient but for one rounding
    exact = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in total])
    away = F.zip_with("x", exact, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(38,0)"))
    fit = fit.withColumn("away", away)
    zero = F.lit(0).cast("decimal(38,0)")
    squares = F.aggregate("away", zero, lambda a, d: F.try_add(a, F.try_multiply(d, d)).cast("decimal(38,0)"))
    fit = fit.withColumn("deviation", squares.try_cast("long")).withColumn("centred", F.transform("away", lambda d: d.cast("double") / F.lit(float(n))))
    fit = written(fit.select("position", "x", "deviation", "centred"), "fit")

    blocks = distributed(fit, n, width)
    covariance = own_product(blocks) / n
    values, axes = eigen(covariance, components)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    matrix = axes / np.sqrt(values)
    tall = blocks.colsPerBlock
    parts = [((at // tall, 0), Matrices.dense(len(part := matrix[at : at + tall]), len(values), part.ravel(order="F"))) for at in range(0, width, tall)]
    whitener = BlockMatrix(spark.sparkContext.parallelize(parts, 1), tall, len(values), width, len(values))
    projected = blocks.multiply(whitener)
    error = float(np.abs(own_product(projected) / n - np.eye(len(values))).max())

    found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = written(found.select(F.col("index").alias("position"), vector_to_array("vector").alias("white")), "white")
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    by_vector = fit.select("position", "x", "deviation").join(white, "position").select("x", "deviation", "white")
    share = F.array(*[F.lit(float(e)) for e in values / np.trace(covariance)])
    return (
        rows.join(by_vector, "x")
        .select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )

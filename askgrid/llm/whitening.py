"""Embedding whitening with Spark MLlib's BlockMatrix.

Vectors become whole numbers, x = floor(256 * c), and each distinct x is a row of the fit. Its rows are
indexed, centred and put into a distributed BlockMatrix; the transpose times the matrix is the scatter,
whose eigenvectors numpy finds on the driver (its size is the vectors' length squared, whatever the
number of rows); the matrix times the whitening matrix projects the rows. All rows stay in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from askgrid.session import materialise

SCALE = 256
COMPONENTS = 4
#: Bytes of a block of the matrix, and blocks whose products are summed in a task.
BLOCK_BYTES = 1 << 20
BLOCKS_PER_TASK = 8
#: Components with less than this share of the greatest eigenvalue can't be told from rounding.
LEAST_SHARE = 1e-12

_COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vector: Column) -> Column:
    """floor(256 * c) of all entries; null if the vector is null or has a null or non-finite entry."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * SCALE)))


def _fit_rows(x: DataFrame) -> DataFrame:
    """Each distinct x once, with an index from 0 on."""
    numbered = x.distinct().select(F.monotonically_increasing_id().alias("_place"), "_x")
    numbered = materialise(numbered.withColumn("_part", F.shiftright("_place", 33)), "fit")
    sizes = numbered.groupBy("_part").count().orderBy("_part").collect()  # a row for each partition
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    offsets = [Row(_part=r["_part"], _before=b) for r, b in zip(sizes, before, strict=False)]
    offsets = x.sparkSession.createDataFrame(offsets, "_part long, _before long")
    first = F.col("_place").bitwiseAND((1 << 33) - 1)
    return numbered.join(F.broadcast(offsets), "_part").select((F.col("_before") + first).alias("_index"), "_x")


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each entry of their x."""
    total = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(size)]).first()
    return total["n"], [total[f"s{i}"] or 0 for i in range(size)]


def _block_matrix(rows: DataFrame, mean: list[float], count: int) -> BlockMatrix:
    """Centred rows as a BlockMatrix with all columns of a row in one block, as far as 1,024 go."""
    size = len(mean)
    centred = F.zip_with("_x", F.array(*[F.lit(m) for m in mean]), lambda c, m: c.cast("double") - m)
    vectors = rows.select(F.col("_index").alias("index"), array_to_vector(centred).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, size)
    columns = min(size, 1024)
    return indexed.toBlockMatrix(max(1, BLOCK_BYTES // (8 * columns)), columns).persist(StorageLevel.MEMORY_AND_DISK)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. The sum over row blocks is dealt out to many tasks; each passes on one
    partial sum. (PySpark's `multiply` has no such argument and would bring all row blocks to one task.)"""
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    left, right = (m._java_matrix_wrapper._java_model for m in (matrix.transpose(), matrix))
    product = left.multiply(right, max(1, -(-blocks // BLOCKS_PER_TASK)))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _projected(matrix: BlockMatrix, whitening: np.ndarray) -> DataFrame:
    """_index and _y: rows of the matrix times `whitening`."""
    size, components = whitening.shape
    step = matrix.colsPerBlock
    parts = [(i, whitening[i * step : (i + 1) * step]) for i in range(-(-size // step))]
    blocks = [((i, 0), Matrices.dense(len(p), components, p.flatten("F").tolist())) for i, p in parts]
    spark_context = matrix.blocks.context
    product = matrix.multiply(BlockMatrix(spark_context.parallelize(blocks, 1), step, components, size, components))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select(F.col("index").alias("_index"), vector_to_array("vector").alias("_y"))


def _identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the projected rows minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    y = F.col("_y")
    sums = projected.agg(
        F.count("*").alias("n"),
        *[F.sum(y[i]).alias(f"s{i}") for i in range(components)],
        *[F.sum(y[i] * y[j]).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    mean = [sums[f"s{i}"] / sums["n"] for i in range(components)]
    return max(abs(sums[f"p{i}_{j}"] / sums["n"] - mean[i] * mean[j] - (i == j)) for i, j in pairs)


def whiten(docs: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns of `docs` but `vector`, with component, n, deviation, whitened, explained and identity_error;
    a row for each remaining row of `docs` and component.

    Rows whose vector is null or holds null or non-finite entries are left out. n is the number of distinct x
    vectors, deviation the sum of (n * x - S) ** 2 over the entries (null if it doesn't fit a long),
    explained the component's share of the variance. There are at most as many components as the variance
    has dimensions, so with fewer than two distinct vectors, or an empty table, the result is empty. Vectors shorter
    than the longest count as if zeros followed. Equal rows each get the same result; among equal eigenvalues
    the solver's order decides. Columns that are called like the added ones are replaced. The sums need a column
    of an aggregate for each entry, and the scatter memory for the square of their number on the driver.
    """
    added = [c.split()[0] for c in _COLUMNS.split(", ")]
    others = [c for c in docs.columns if c not in (vector, *added, "_x")]
    rows = docs.select(*others, whole_numbers(F.col(vector)).alias("_x")).where(F.col("_x").isNotNull())
    sizes = rows.agg(F.max(F.size("_x")).alias("most"), F.min(F.size("_x")).alias("least")).first()
    size = sizes["most"] or 0
    if sizes["least"] != size:
        zeros = F.array_repeat(F.lit(0).cast("long"), size)
        rows = rows.withColumn("_x", F.slice(F.concat("_x", zeros), 1, max(1, size)))
    nothing = rows.limit(0).select(*others, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _COLUMNS.split(", ")])
    if not size:
        return nothing
    fit = _fit_rows(rows.select("_x"))
    n, sums = _sums(fit, size)
    matrix = _block_matrix(fit, [s / n for s in sums], n)
    try:
        variance, axes = np.linalg.eigh(_scatter(matrix) / n)
        variance, axes = variance[::-1], axes[:, ::-1]
        trace = float(variance.sum())
        kept = int((variance[:components] > max(0.0, LEAST_SHARE * variance[0])).sum())
        if not kept:
            return nothing
        whitening = axes[:, :kept] / np.sqrt(variance[:kept])
        projected = materialise(_projected(matrix, whitening), "projected")
    finally:
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = _identity_error(projected, kept)
    apart = F.zip_with("_x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda c, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), c), s))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    share = F.array(*[F.lit(float(v / trace)) for v in variance[:kept]])
    fitted = fit.join(projected, "_index").select("_x", "_y", deviation.alias("deviation"))
    return (
        rows.join(fitted, "_x")
        .select(*others, "deviation", F.posexplode("_y").alias("_place", "whitened"))
        .select(
            *others,
            (F.col("_place") + 1).alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            share[F.col("_place")].alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

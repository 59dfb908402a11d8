"""Whitening of embeddings with distributed block matrices.

Vectors are made whole numbers, so that counts, sums and deviations are exact whatever the order of adding. The
distinct vectors, centred, become indexed rows of an MLlib ``BlockMatrix``; its transpose times itself is the scatter, in parts
along the rows so that no task adds up all blocks. The eigenvectors of that small matrix (dimensions x dimensions) are
found on the driver, and a second block multiplication projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, table
from tagspark.llm.ordered import numbered, partitions

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows and columns of a block: 8 MB of doubles.
SIDE = 1024
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What a fit found: distinct vectors, their sums, total variance, falling eigenvalues and eigenvectors (dimensions x components)."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = float("nan")

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole(embedding: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a null vector or one with a null, infinite or undefined entry."""
    odd = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~odd, F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows with whole vectors. Vectors of another length than most (ties: the longer) are no vectors of this space
    and are left out, and so are empty ones."""
    rows = embeddings.select("vec_id", whole(F.col("embedding")).alias("x")).where("x is not null and size(x) > 0")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _sums(rows: DataFrame) -> np.ndarray:
    """Sum of x in each dimension; each task gives one row a dimension."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["dim", "s"])

    found = in_batches(rows.select("x"), add, "dim int, s long").groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim")
    return np.array([r["s"] for r in found.collect()], np.int64)  # a row for each dimension


def _numbers(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def centred(rows: DataFrame, index: str, n: int, sums: np.ndarray) -> IndexedRowMatrix:
    mean = _numbers((sums / n).tolist())
    vectors = rows.select(index, array_to_vector(F.zip_with("x", mean, lambda x, m: x - m)).alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"))


def _product(a: BlockMatrix, b: BlockMatrix, parts: int) -> BlockMatrix:
    """a times b, the dimension they share dealt out over ``parts`` groups of tasks."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def gram(a: BlockMatrix, parts: int) -> np.ndarray:
    """The small matrix a' a, on the driver: columns x columns."""
    return np.asarray(_product(a.transpose(), a, parts).toLocalMatrix().toArray())


def _blocks(sc, small: np.ndarray, side: int) -> BlockMatrix:
    parts = [((i, 0), DenseMatrix(*x.shape, x.ravel(order="F"))) for i, at in enumerate(range(0, len(small), side)) for x in [small[at : at + side]]]
    return BlockMatrix(sc.parallelize(parts, 1), side, small.shape[1])


def fit(rows: DataFrame, components: int = COMPONENTS, side: int = SIDE) -> Whitening | None:
    """Learn from the distinct vectors ``x`` of ``rows``; None without any. Components without variance are left out."""
    distinct = numbered(rows.select("x").distinct(), [], "row", "vectors")
    n = distinct.count()
    if not n:
        return None
    sums = _sums(distinct)
    parts = max(1, min(partitions(rows), -(-n // side)))
    a = centred(distinct, "row", n, sums).toBlockMatrix(side, side)
    cov = gram(a, parts) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0) * len(values) * 1e-14
    values, vectors = values[real][:components], vectors[:, real][:, :components]
    if not len(values):
        return Whitening(n, sums, 0.0, values, vectors)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    found = Whitening(n, sums, float(np.trace(cov)), values, vectors)
    z = a.multiply(_blocks(rows.sparkSession.sparkContext, found.matrix, side))
    mean = z.toIndexedRowMatrix().toRowMatrix().computeColumnSummaryStatistics().mean()
    error = np.abs(gram(z, parts) / n - np.outer(mean, mean) - np.eye(len(values))).max()
    return Whitening(n, sums, found.trace, values, vectors, float(error))


def project(rows: DataFrame, index: str, model: Whitening, side: int = SIDE) -> DataFrame:
    """(index, whitened array<double>) of rows with a dense ``index`` and ``x``."""
    a = centred(rows, index, model.n, model.sums).toBlockMatrix(side, side)
    z = a.multiply(_blocks(rows.sparkSession.sparkContext, model.matrix, side)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", z._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias(index), vector_to_array("vector").alias("whitened"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, side: int = SIDE) -> DataFrame:
    """For each usable row of ``embeddings`` (vec_id, embedding; other columns are passed over) and each component: the contract's columns.

    Rows with a null vector or a null, infinite or undefined entry go, and those of another length than most. Equal
    vectors count once in the fit and all come back. One distinct vector alone has no component, so no row comes back; an empty table gives
    none either. A deviation beyond a long is null; entries must stay below 2^50.
    """
    spark = embeddings.sparkSession
    rows = numbered(usable(embeddings), [], "row", "embeddings")
    model = fit(rows, components, side)
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    gaps = F.zip_with("x", _numbers(model.sums.tolist()), lambda x, s: (x * F.lit(model.n) - s).cast("decimal(19,0)"))
    deviation = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g * g).cast("decimal(38,0)")).try_cast("long")
    both = rows.select("row", "vec_id", deviation.alias("deviation")).join(project(rows, "row", model, side), "row")
    long = both.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(_numbers((model.values / model.trace).tolist()), F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_whitening(spark, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))

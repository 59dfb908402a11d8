"""Support vector machines with a Gaussian kernel, by landmarks (Nystroem).

A bounded sample of training vectors are the landmarks. A record's kernel values with them, times the inverse square root of the
landmarks' own kernel matrix, make a short dense vector whose inner products stand for the kernel; on these the squared-hinge solver
fits one scorer for each class. With every distinct training vector a landmark the kernel is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.operators.linear import FEATURES, arrow_vectors, fit_linear, margins
from tagspark.operators.weights import TermVectors
from tagspark.session import keep_table, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Landmarks at most, about: they are chosen by a hash of the vector's own row. Their matrix (landmarks x the terms that any of them has) is sent to the executors.
LANDMARKS = 200


def gaussian(dots: np.ndarray, left: np.ndarray, right: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - l|^2) from inner products and squared lengths."""
    return np.exp(-gamma * np.maximum(left[:, None] + right[None, :] - 2 * dots, 0.0))


@dataclass(frozen=True)
class KernelMap:
    """Landmarks (landmarks x the terms that any of them has), the matrix that turns kernel values into coordinates, gamma, and those terms' places."""

    landmarks: np.ndarray
    turn: np.ndarray
    gamma: float
    terms: np.ndarray

    def apply(self, vectors: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and ``features``: the coordinates of each row."""
        shared = vectors.sparkSession.sparkContext.broadcast((np.ascontiguousarray(self.landmarks.T), np.einsum("ij,ij->i", self.landmarks, self.landmarks), self.turn, self.gamma, self.terms))
        rows = vectors.select(*keep, FEATURES)
        schema = rows.drop(FEATURES).withColumn("_x", F.array(F.lit(0.0))).schema

        def run(batches):
            import pyarrow as pa

            points, lengths, turn, gamma, terms = shared.value
            for batch in batches:
                index, flat, offsets = arrow_vectors(batch.column(batch.schema.get_field_index(FEATURES)))
                n = len(offsets) - 1
                own = np.zeros(n)
                np.add.at(own, np.repeat(np.arange(n), np.diff(offsets)), flat * flat)
                # a term that no landmark has adds to the row's length only
                place = np.searchsorted(terms, index)
                met = np.flatnonzero(terms[np.minimum(place, len(terms) - 1)] == index) if len(terms) else np.zeros(0, np.int64)
                offsets = np.searchsorted(met, offsets)
                x = gaussian(margins(place[met], flat[met], offsets, points, np.zeros(len(lengths))), own, lengths, gamma) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], schema.names)

        return rows.mapInArrow(run, schema).select(*keep, array_to_vector("_x").alias(FEATURES))


def kernel_map(vectors: DataFrame, gamma: float = 1.0, landmarks: int = LANDMARKS, seed: int = fixed.SEED) -> KernelMap:
    """A map from a sample of about ``landmarks`` distinct vectors of ``features``, at most twice as many. Vectors of length 1 suit a gamma of 1."""
    text = F.col(FEATURES).cast("string")
    n = vectors.select(text).distinct().count()
    place = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = vectors.where(place < min(1.0, landmarks / max(n, 1))) if n > landmarks else vectors
    points = [r[0] for r in chosen.select(FEATURES, text.alias("_t")).dropDuplicates(["_t"]).orderBy("_t").select(FEATURES).limit(2 * landmarks).collect()]
    if not points:
        points = [r[0] for r in vectors.select(FEATURES).limit(1).collect()]
    cells = [(np.arange(len(p)), p.toArray()) if isinstance(p, DenseVector) else (p.indices, p.values) for p in points]
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *(i for i, _ in cells)])).astype(np.int64)
    own = np.zeros((len(points), len(terms)))
    for row, (index, value) in zip(own, cells, strict=True):
        row[np.searchsorted(terms, index)] = value
    lengths = np.einsum("ij,ij->i", own, own)
    values, basis = np.linalg.eigh(gaussian(own @ own.T, lengths, lengths, gamma)) if len(own) else (np.zeros(0), np.zeros((0, 0)))
    real = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return KernelMap(own, basis[:, real] / np.sqrt(values[real]), gamma, terms)


@dataclass
class KernelModel:
    """A map and one scorer for each class."""

    features: TermVectors
    map: KernelMap
    classes: list[str]
    coef: np.ndarray
    intercept: np.ndarray
    clean: bool = True

    def predict(self, df: DataFrame, corpus: str = "corpus", keep: Sequence[str] = ("org_id",)) -> DataFrame:
        """``keep`` columns and ``class_code``: the class of the largest margin, the first on ties."""
        from tagspark.operators import models

        text = models.clean_text(F.col(corpus)) if self.clean else F.col(corpus)
        rows = models.featurise(df.withColumn("_text", text), "_text", models._CLASS_FEATURES, self.features, keep)
        scored = models._score_vectors(self.map.apply(rows, keep), keep, self.coef, self.intercept, "margin")
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_min(F.zip_with("_scores", names, lambda s, c: F.struct((-s).alias("neg"), c.alias("code"))))
        return scored.select(*keep, best["code"].alias("class_code"))


def fit_kernel_svc(
    train: DataFrame, corpus: str = "corpus", label: str = "class_code", c: float = 1.0, gamma: float = 1.0,
    landmarks: int = LANDMARKS, clean: bool = True, seed: int = fixed.SEED,
) -> KernelModel:
    """Gaussian support vector machines on tf-idf words, one class against the rest."""
    from tagspark.operators import models

    text = models.clean_text(F.col(corpus)) if clean else F.col(corpus)
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).alias("_class"), text.alias("_text"))
    tokens = models.keep_for_fits(models._tokenised(rows, "_text", models._CLASS_FEATURES))
    stages = models.feature_union(tokens, models._CLASS_FEATURES)
    vectors = keep_table(stages.transform(tokens.select("_class", "_words")).select("_class", FEATURES), "kernel")
    found = kernel_map(vectors, gamma, landmarks, seed)
    mapped = keep_table(found.apply(vectors, ["_class"]).select(F.array("_class").alias("labels"), FEATURES), "kernel-mapped")
    try:
        labels, coef, intercept, _ = fit_linear(mapped, "squared_hinge", 1.0 / (c * max(1, mapped.count())), regularise_bias=True)
    finally:
        release(tokens, vectors, mapped)
    return KernelModel(stages, found, labels, coef, intercept, clean)

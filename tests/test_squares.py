"""Squared lengths of the parts of a vector, read from the values held: a vector as wide as a large vocabulary is never written out."""

from pyspark.ml.linalg import Vectors

from checks.q_models import _part_squares


def test_squares_of_very_wide_vectors(spark):
    wide = 1 << 30
    rows = [("a", Vectors.sparse(wide, {0: 3.0, 6: 4.0, wide - 1: 2.0})), ("b", Vectors.sparse(wide, {})), (None, Vectors.sparse(wide, {7: 0.5})), ("a", Vectors.dense([1.0, 2.0]))]
    vectors = spark.createDataFrame(rows, ["org_id", "features"])
    got = sorted(map(tuple, _part_squares(vectors, 7).collect()), key=str)
    assert got == sorted([("a", 25.0, 4.0), ("b", 0.0, 0.0), (None, 0.0, 0.25), ("a", 5.0, 0.0)], key=str)

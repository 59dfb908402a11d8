"""The slope check of the multinomial fit reads what sparse rows hold, not every term of every row."""

import numpy as np
from pyspark.ml.linalg import Vectors

from checks.q_models import _slopes


def test_slopes_equal_the_dense_product(spark):
    x = [Vectors.sparse(5, [0, 3], [1.0, 2.0]), Vectors.sparse(5, [3], [0.5]), Vectors.dense([0.0, 1.0, 0.0, 3.0, 0.0]), Vectors.sparse(5, [], [])]
    p, own = [[0.2, 0.8], [0.6, 0.4], [0.5, 0.5], [0.1, 0.9]], ["A", "B", "B", "A"]
    rows = spark.createDataFrame(list(zip(x, p, own)), ["features", "p", "class_code"])
    d = np.array(p) - np.array([[c == "A", c == "B"] for c in own])
    want = np.array([v.toArray() for v in x]).T @ d
    got = np.zeros((5, 2))
    for r in _slopes(rows, ["A", "B"]).collect():
        got[r.term, "AB".index(r.class_code)] += r.slope
    assert np.allclose(got, want)


def test_a_wide_vocabulary_makes_no_row_per_empty_cell(spark):
    rows = spark.createDataFrame([(Vectors.sparse(1_000_000, [7], [1.0]), [0.5, 0.5], "A")] * 20, ["features", "p", "class_code"])
    assert {(r.term, r.class_code) for r in _slopes(rows, ["A", "B"]).collect()} == {(7, "A"), (7, "B")}

"""The comparison's report of every class, beside the measures of the whole; and a map whose landmarks hold their own terms only."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tagspark.operators import kernel, metrics


def test_report_of_each_class(spark):
    pairs = [("A", "A"), ("A", "A"), ("A", "B"), ("B", "B"), ("B", "C"), (None, "A"), ("D", None)]
    df = spark.createDataFrame([("m", *p) for p in pairs] + [("n", "A", "A")], "classifier string, t string, p string")
    plain = {r.classifier: r.asDict() for r in metrics.multiclass_metrics(df, "t", "p", by=("classifier",)).collect()}
    found = {r.classifier: r.asDict() for r in metrics.multiclass_metrics(df, "t", "p", by=("classifier",), report=True).collect()}
    assert all(found[k][c] == v for k in plain for c, v in plain[k].items())
    classes = [tuple(c) for c in found["m"]["classes"]]
    assert classes == [
        ("A", pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3), 3), ("B", 0.5, 0.5, 0.5, 2), ("C", 0.0, 0.0, 0.0, 0), ("D", 0.0, 0.0, 0.0, 1), (None, 0.0, 0.0, 0.0, 1),
    ]
    assert found["m"]["precision_weighted"] == found["m"]["recall_weighted"] == pytest.approx(3 / 7)
    assert [tuple(c) for c in found["n"]["classes"]] == [("A", 1.0, 1.0, 1.0, 1)]


def test_landmarks_hold_their_own_terms_only(spark):
    width = 5_000_000  # written out, 20 such rows would take 800 MB
    r = np.random.default_rng(4)
    x = [sorted({int(i) for i in r.integers(0, width, 6)} | {7}) for _ in range(60)]
    df = spark.createDataFrame([(i, Vectors.sparse(width, at, [0.4] * len(at))) for i, at in enumerate(x)], ["i", "features"])
    made = kernel.kernel_map(df, 1.0, 20)
    assert made.landmarks.shape[1] == len(made.terms) <= 6 * len(made.landmarks) + 1
    rows = sorted(made.apply(df, ["i"]).collect())
    phi = np.array([v.features.toArray() for v in rows])
    known = {tuple(made.terms[row > 0]): i for i, row in enumerate(made.landmarks)}
    at = [i for i, t in enumerate(x) if tuple(t) in known]
    assert len(at) == len(made.landmarks)
    sets = [set(t) for t in x]
    exact = np.array([[np.exp(-0.16 * (len(sets[a]) + len(sets[b]) - 2 * len(sets[a] & sets[b]))) for b in at] for a in range(60)])
    assert np.abs(phi @ phi[at].T - exact).max() < 1e-6

"""The landmark kernel: exact with all landmarks, close with some; what no linear model can tell apart."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tagspark.operators import kernel


def vectors(spark, x):
    return spark.createDataFrame([(i, Vectors.sparse(x.shape[1], {j: float(v) for j, v in enumerate(row) if v})) for i, row in enumerate(x)], ["i", "features"]).repartition(3)


def test_kernel_error_falls_with_landmarks(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 8)) * (r.random((120, 8)) < 0.6)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x[5], x[6] = 0.0, x[7]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2))
    df, errors = vectors(spark, x), []
    for m in (10, 40, 120):
        made = kernel.kernel_map(df, 1.0, m)
        assert len(made.landmarks) <= 2 * m
        rows = sorted(made.apply(df, ["i"]).collect())
        phi = np.array([v.features.toArray() for v in rows])
        errors.append(np.abs(phi @ phi.T - exact).max())
    assert errors[2] < 1e-6 and errors[2] < errors[1] < errors[0] < 1.0
    again = kernel.kernel_map(df.repartition(7), 1.0, 40)
    assert again.landmarks.tolist() == kernel.kernel_map(df, 1.0, 40).landmarks.tolist()


@pytest.mark.parametrize("landmarks", [30, 400])
def test_words_that_only_tell_together(spark, landmarks):
    """Both words or neither: one class; one of them: the other."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(160):
        a, b = r.integers(0, 2, 2)
        words = ["red"] * int(a) * 3 + ["blue"] * int(b) * 3 + ["base", f"w{r.integers(0, 4)}"]
        rows.append((i, " ".join(words), "AB"[int(a != b)]))
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", "A")], "org_id int, corpus string, class_code string")
    model = kernel.fit_kernel_svc(df, c=10.0, landmarks=landmarks)
    got = {r.org_id: r.class_code for r in model.predict(df).collect()}
    assert len(got) == 162 and model.classes == ["A", "B"]
    assert sum(got[i] == c for i, _, c in rows) >= 0.95 * len(rows)

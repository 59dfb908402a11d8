"""Stochastic fits: repeatable, close to the optimum, step by step as plain Python has it."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tagspark.operators import linear, models, stochastic


def rows(spark, n=600, d=12, parts=3):
    r = np.random.default_rng(8)
    w = r.normal(size=(d, 2)) * 2
    out = []
    for i in range(n):
        at = np.sort(r.choice(d, 5, replace=False))
        x = r.normal(size=5) / 2
        y = x @ w[at] + r.normal(size=2) > [0.3, 1.0]
        out.append((Vectors.sparse(d, at.tolist(), x.tolist()), [c for c, k in zip("AB", y, strict=True) if k]))
    out.append((Vectors.sparse(d, [], []), None))
    return spark.createDataFrame(out, ["features", "labels"]).repartition(parts)


def objective(df, coef, intercept, loss, alpha):
    data = df.collect()
    x = np.array([r.features.toArray() for r in data])
    out = []
    for k, c in enumerate("AB"):
        y = np.array([1.0 if c in (r.labels or []) else -1.0 for r in data])
        out.append(stochastic.value(loss, y * (x @ coef[k] + intercept[k])).mean() + alpha / 2 * (coef[k] ** 2).sum())
    return np.array(out)


@pytest.mark.parametrize(("loss", "full"), [("log_loss", "logistic"), ("modified_huber", "modified_huber")])
def test_close_to_the_optimum_and_repeatable(spark, loss, full):
    df, alpha = rows(spark), 1e-3
    labels, coef, b, report = models.fit_ovr_sgd(df, loss, alpha, passes=60)
    assert labels == ["A", "B"] and all(x["passes"] >= stochastic.PATIENCE for x in report.values())
    best = objective(df, *linear.fit_linear(df, full, alpha, tol=1e-6)[1:3], loss, alpha)
    got = objective(df, coef, b, loss, alpha)
    assert (got <= 1.05 * best + 1e-3).all() and (got >= best - 1e-6).all()
    # other partitions, same parts and order: the same numbers
    again = models.fit_ovr_sgd(rows(spark, parts=7), loss, alpha, passes=60)
    assert (again[1] == coef).all() and (again[2] == b).all()
    other = models.fit_ovr_sgd(df, loss, alpha, passes=60, seed=1)
    assert (other[1] != coef).any() and np.abs(other[1] - coef).max() < 1.0
    several = stochastic.fit_stochastic(df, loss, alpha, passes=60, part_rows=100)  # means over tiny parts are further off
    assert (objective(df, several[1], several[2], loss, alpha) <= 1.25 * best).all()


def test_a_pass_by_plain_steps():
    r = np.random.default_rng(2)
    data = [(np.array([0, 2]), r.normal(size=2), r.random(2) < 0.5) for _ in range(20)] + [(np.array([1]), np.array([1.0]), np.array([True, False]))]
    up, down, live, alpha, t0 = np.array([1.0, 2.0]), np.array([1.0, 0.5]), np.array([True, True]), 0.05, 30.0
    w, b, _ = stochastic.one_pass(data, np.zeros((3, 2)), np.zeros(2), "log_loss", alpha, t0, up, down, live)
    want, bias, t = np.zeros((3, 2)), np.zeros(2), t0
    for at, x, y in data:
        t += 1
        x_all = np.zeros(3)
        x_all[at] = x
        for k in range(2):
            s = 1.0 if y[k] else -1.0
            d = -s / (1 + np.exp(s * (x_all @ want[:, k] + bias[k]))) * (up[k] if y[k] else down[k])
            want[:, k] = want[:, k] * (1 - 1 / t) - x_all * d / (alpha * t)
            bias[k] -= stochastic.INTERCEPT_SHARE * d / (alpha * t)
    assert np.abs(w - want).max() < 1e-9 and np.abs(b - bias).max() < 1e-9
    still = stochastic.one_pass(data, np.ones((3, 2)), np.zeros(2), "modified_huber", alpha, t0, up, down, np.array([False, True]))[0]
    assert (still[:, 0] == 1).all() and (still[:, 1] != 1).any()


def test_slopes_and_odd_input(spark):
    z = np.linspace(-3, 3, 601) + 1e-4
    for loss in ("log_loss", "modified_huber"):
        assert np.abs((stochastic.value(loss, z + 1e-6) - stochastic.value(loss, z - 1e-6)) / 2e-6 - stochastic.slope(loss, z)).max() < 1e-3
    with pytest.raises(ValueError):
        stochastic.fit_stochastic(rows(spark, 3), "hinge", 1e-3)
    bare = spark.createDataFrame([(Vectors.sparse(2, [0], [1.0]), ["x"])], ["features", "labels"]).selectExpr("features", "cast(array() as array<string>) labels")
    assert stochastic.fit_stochastic(bare, "log_loss", 1e-3)[0] == []

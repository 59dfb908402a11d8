"""Whitening against numpy, with copies, broken rows and odd spaces."""

import numpy as np
import pytest

from tagspark.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, row string, x int"


def by_numpy(vectors):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("side", [1024, 16])
def test_against_numpy(spark, side):
    r = np.random.default_rng(3)
    d = 20
    vectors = (r.normal(size=(300, d)) * np.linspace(0.2, 3, d)) @ r.normal(size=(d, d))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7].tolist()) for i in range(150)]
    bad = [(1, None), (2, [None] + [1.0] * 19), (3, [float("nan")] * 20), (4, [float("inf")] + [0.0] * 19), (5, []), (6, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "own", 1) for x in rows + bad], SCHEMA).repartition(5)
    got = whiten(df, side=side).toPandas()
    n, deviation, white, explained = by_numpy([v for _, v in rows])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 16 * len(rows) and set(got.n) == {n} == {300} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    signs = np.sign((mine * white[:, :16]).sum(axis=0))
    assert np.abs(mine * signs - white[:, :16]).max() < 1e-9
    assert got.drop_duplicates("component").sort_values("component").explained.to_numpy() == pytest.approx(explained[:16])
    one = got[got.component == 1].set_index("vec_id")
    assert [one.deviation[i] for i, _ in rows] == deviation.tolist()


def test_few_dimensions_no_variance_and_nothing(spark):
    frame = lambda rows: spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)
    got = whiten(frame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0]), (None, [2.0, 5.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation) for r in got) == [("1", 1, 3, 192**2), ("2", 1, 3, 0), ("2", 1, 3, 0), ("None", 1, 3, 192**2)]
    assert all(r.explained == 1.0 and r.identity_error < 1e-9 for r in got)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whiten(frame(rows))
        assert out.count() == 0 and out.columns[0] == "vec_id"

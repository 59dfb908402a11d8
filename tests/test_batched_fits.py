"""Many fits at once are the fits one by one, and take no more jobs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.operators import linear, models
from tagspark.operators.linear import Target, View
from tagspark.plans import grid

WORDS = "care school river music sport food house garden library history".split()


def gold(spark, n=160, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = r.integers(0, 4)
        words = [*r.choice(WORDS, 6), *[WORDS[k]] * 3, f"rare{r.integers(0, 30)}"]
        rows.append((f"o{i:03}", " ".join(words), ";".join(["AA101", "BB102", "BB201", "CC300"][j] for j in {k, r.integers(0, 4)}), ["A10", "A20", "B10", "C30"][k]))
    return spark.createDataFrame([(a, t, t, c, k) for a, t, c, k in rows], "org_id string, corpus string, activities string, tags string, class_code string").withColumn("name", F.lit("")).withColumn("objects", F.lit(""))


def by_term(model):
    """Coefficients with the terms in alphabetical order: terms of equal counts have no order of their own."""
    return model.coef[:, np.argsort(model.features.stages[0].vocabulary)]


@pytest.fixture
def steps(monkeypatch):
    count, real = [], linear._evaluate
    monkeypatch.setattr(linear, "_evaluate", lambda *a: count.append(1) or real(*a))
    return count


def test_many_settings_equal_single_fits(spark, steps):
    g = gold(spark)
    base = models.Settings(clean_text=False, min_df=1)
    settings = [models.Settings(**{**vars(base), **x}) for x in (
        {"model_c": 1.0}, {"model_c": 2.0, "class_weight_mode": "balanced"}, {"model_family": "sgd", "sgd_loss": "modified_huber", "sgd_alpha": 1e-3})]
    parts = {"first": g.where("org_id < 'o100'"), "second": g.where("org_id >= 'o060'")}
    found = models.train_many({k: (v, settings) for k, v in parts.items()})
    took = [x["steps"] for ms in found.values() for m in ms for x in m.info["steps"].values()]
    assert max(took) <= len(steps) <= max(took) + 2 < sum(took)
    names = [str(i) for i in range(len(settings))]
    ranked = {(r["name"], r.org_id): {x.code: -x.neg for x in r.ranked} for r in models.ranked_many(found["first"], names, g).collect()}
    for i, s in enumerate(settings):
        one, many = models.train_final(parts["first"], s), found["first"][i]
        assert one.labels == many.labels and one.link == many.link
        assert np.abs(by_term(one) - by_term(many)).max() < 1e-3 and np.abs(one.intercept - many.intercept).max() < 1e-3
        for r in one.ranked(g).collect():
            assert all(abs(-x.neg - ranked[str(i), r.org_id][x.code]) < 1e-3 for x in r.ranked)
    with pytest.raises(ValueError):
        models.train_many({"x": (g, [base, models.Settings(clean_text=False, ngram_max=2)])})


def test_blocks_of_targets_and_the_tree_of_sums(spark, monkeypatch):
    _, kept = models.prepared(gold(spark), models.Settings(clean_text=False, min_df=1))
    labels, coef, intercept, _ = linear.fit_linear(kept, "logistic", 0.01)
    monkeypatch.setattr(linear, "BLOCK_BYTES", 500)
    monkeypatch.setattr(linear, "DIRECT_BYTES", 0)
    monkeypatch.setattr(linear, "PACK_VALUES", 50)
    again, coef2, intercept2, report = linear.fit_linear(kept, "logistic", 0.01)
    assert again == labels and np.abs(coef - coef2).max() < 1e-9 and np.abs(intercept - intercept2).max() < 1e-9
    assert all(x["converged"] for x in report.values())


def test_softmax_by_numpy(spark):
    """The joint fit of all classes against plain gradient steps."""
    _, kept = models.prepared(gold(spark, 60), models.Settings(clean_text=False, min_df=1), truth="class_code")
    rows = kept.collect()
    x, names = np.array([r.features.toArray() for r in rows]), ["A10", "A20", "B10", "C30"]
    y = np.array([[r.labels[0] == c for c in names] for r in rows], float)
    w, b, l2 = np.zeros((x.shape[1], 4)), np.zeros(4), 0.05
    for _ in range(4000):
        e = np.exp(x @ w + b)
        d = (e / e.sum(axis=1, keepdims=True) - y) / len(x)
        w, b = w - 1.0 * (x.T @ d + l2 * w), b - 1.0 * d.sum(axis=0)
    f = linear.fit_views({"v": View(kept, [Target(c, "softmax", l2, group="g") for c in names])}, tol=1e-8)["v"]
    assert np.abs(f.coef.T - w).max() < 1e-4 and np.abs(f.intercept - f.intercept.mean() - b + b.mean()).max() < 1e-4


def test_two_steps_equal_separate_fits(spark, steps):
    g = gold(spark)
    model = models.fit_two_step(g)
    together = len(steps)
    assert sorted(model.inside) == ["A"] and model.single == {"B": "B10", "C": "C30"}
    alone = models.fit_two_step(g.where("class_code like 'A%'"))
    assert np.abs(by_term(alone.inside["A"]) - by_term(model.inside["A"])).max() < 1e-6
    steps.clear()
    models.fit_two_step(g.where("class_code like 'A%'"))
    assert together < 2 * len(steps) + 200
    got = {r.org_id: (r.section, r.class_code) for r in model.predict(g).collect()}
    truth = {r.org_id: r.class_code for r in g.collect()}
    assert len(got) == 160 and all(c[0] == s for s, c in got.values())
    assert sum(c == truth[i] for i, (_, c) in got.items()) > 150


def test_search_scores_every_seed_and_setting(spark):
    g = gold(spark)
    values = {"clean_text": [False], "model_family": ["logistic"], "threshold": [0.3], "ngram_max": [1, 2], "char_ngram_max": [0], "model_c": [1.0, 5.0],
              "class_weight_mode": ["none"], "fallback_mode": ["top_k"], "top_k_fallback": [0], "fallback_min_score": [0.0]}
    params = grid.param_grid(spark, "ovr_logistic", values)
    scored = grid.score_fits(g, [], params, [1, 2], 0.25)
    rows = scored.groupBy("seed", "fit_key").count().collect()
    assert len(rows) == 8 and all(r["count"] == 40 for r in rows)
    with pytest.raises(ValueError):
        grid.score_fits(g, [], params.limit(0), [1])


def test_a_step_does_not_copy_the_history():
    width, n = 40_000, 3
    search = linear._Search(width, 1, np.arange(n), np.full(n, 0.1), np.ones(n, bool), np.full(n, 1e-9))
    target = np.linspace(-1, 1, n * (width + 1)).reshape(n, -1)
    peak = 0
    for _ in range(6):
        trial = search.trial()
        sums = np.c_[0.5 * ((trial - target) ** 2 * np.arange(1, n + 1)[:, None]).sum(axis=1), (trial - target) * np.arange(1, n + 1)[:, None]]
        tracemalloc.start()
        search.take(trial, search.columns, sums[search.columns])
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert search.took.max() >= 2 and peak < 9 * search.w.nbytes
    assert linear.BLOCK_BYTES * (2 * linear._HISTORY + 10) < 300 << 20


def test_a_stored_model_holds_no_zeros_and_shared_features_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(["red red fox", "blue fox", "blue sky", "red sky x1"])], "org_id string, corpus string")
    s = models.Settings(clean_text=False, min_df=1)
    features = models.feature_union(models._tokenised(rows.withColumn("_text", F.col("corpus")), "_text", s), s)
    words = features.stages[0].vocabulary
    assert models.word_places(features, ["sky", "none", "red", "red"], spark) == {w: words.index(w) for w in ("sky", "red")}

    def model(labels, coefs):
        coef = np.zeros((len(labels), len(words)))
        for label, word, w in coefs:
            coef[labels.index(label), words.index(word)] = w
        return models.OvrModel(s, features, labels, coef, np.zeros(len(labels)), "margin")

    first = model(["A", "B"], [("A", "red", 2.0), ("B", "blue", 1.0)])
    made = models.TwoStepModel(first, {"A": model(["A1", "A2"], [("A1", "fox", 1.0), ("A2", "sky", 3.0)])}, {"B": "B1"})
    made.save(spark, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/first/labels").orderBy("position").collect()
    assert [(r["width"], len(r["coef"])) for r in kept] == [(len(words), 1)] * 2
    assert not (tmp_path / "inside" / "A" / "features").exists()
    back = models.TwoStepModel.load(spark, str(tmp_path))
    assert (back.first.coef == first.coef).all() and (back.inside["A"].coef == made.inside["A"].coef).all() and back.inside["A"].features is back.first.features
    assert sorted(map(tuple, back.predict(rows).collect())) == [("0", "A", "A1"), ("1", "B", "B1"), ("2", "B", "B1"), ("3", "A", "A2")]
    empty = model(["A", "B"], [])
    empty.save(spark, f"{tmp_path}/empty")
    assert (models.OvrModel.load(spark, f"{tmp_path}/empty").coef == empty.coef).all()

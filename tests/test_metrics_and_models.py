import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.operators import aggregates, decide, features, linear, metrics, models
from tagspark.plans import grid, workflow
from tagspark.operators.rules import Rule

EVAL = "org_id string, true_codes array<string>, predicted_codes array<string>, prediction_source string"


def eval_rows(spark):
    return spark.createDataFrame(
        [("1", ["a", "b"], ["a"], "x"), ("2", [], [], "x"), ("3", ["a"], ["a", "c"], "x"), ("4", ["b"], [], "x")], EVAL
    )


def test_multilabel_metrics_by_hand(spark):
    m = metrics.multilabel_metrics(eval_rows(spark)).first()
    assert m.rows == 4
    assert m.precision_micro == pytest.approx(2 / 3)
    assert m.recall_micro == pytest.approx(2 / 4)
    assert m.f1_micro == pytest.approx(4 / 7)
    assert m.f1_macro == pytest.approx((1 + 0 + 0) / 3)
    assert m.subset_accuracy == pytest.approx(1 / 4)  # both empty counts as equal
    assert m.jaccard_samples == pytest.approx((1 / 2 + 0 + 1 / 2 + 0) / 4)
    assert m.hamming_loss == pytest.approx(3 / 12)


def test_metrics_of_nothing_are_zero(spark):
    rows = spark.createDataFrame([("1", [], [], "x")], EVAL)
    m = metrics.multilabel_metrics(rows).first()
    assert (m.f1_micro, m.f1_macro, m.hamming_loss, m.subset_accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_multiclass_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    m = metrics.multiclass_metrics(df, "t", "p").first()
    assert m.accuracy == 0.5
    assert m.precision_macro == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert m.recall_macro == pytest.approx((0.5 + 1 + 0) / 3)
    assert m.f1_weighted == pytest.approx((0.5 * 2 + (2 / 3) * 1 + 0) / 4)


def scores(spark):
    rows = [("1", "a", 0.9), ("1", "b", 0.2), ("2", "b", 0.2), ("2", "a", 0.2), ("2", "c", 0.1), ("3", "a", 0.05), ("3", "b", 0.01)]
    return spark.createDataFrame(rows, "org_id string, code string, score double")


def sets(df):
    return {r.org_id: r.predicted_codes for r in df.collect()}


def test_deciders(spark):
    s = scores(spark)
    assert sets(decide.decide_threshold(s, 0.5)) == {"1": ["a"], "2": [], "3": []}
    assert sets(decide.decide_top_k(s, 0.5, 0)) == {"1": ["a"], "2": [], "3": []}
    assert sets(decide.decide_top_k(s, 0.5, 1)) == {"1": ["a"], "2": ["a"], "3": ["a"]}
    assert sets(decide.decide_top_k(s, 0.5, 9))["3"] == ["a", "b"]
    assert sets(decide.decide_max_score(s, 0.5, 0.1)) == {"1": ["a"], "2": ["a"], "3": []}


def aligned(spark):
    return spark.createDataFrame([("1", ["a", "b"], ["x"]), ("2", ["a"], ["b", "c", "x"]), ("3", [], ["a"])],
                                 "org_id string, model_codes array<string>, rule_codes array<string>")


def test_hybrids(spark):
    a, s = aligned(spark), scores(spark)
    assert sets(decide.hybrid_fallback(a)) == {"1": ["a", "b"], "2": ["a", "b", "c", "x"], "3": ["a"]}
    assert sets(decide.hybrid_high_conf(a, s)) == {"1": ["a", "b", "x"], "2": ["a"], "3": []}
    assert sets(decide.hybrid_gated(a, s, 0.15)) == {"1": ["a", "b"], "2": ["a", "b"], "3": []}
    # A rule code the model does not know scores 0.
    assert sets(decide.hybrid_gated(a, s, 0.0))["1"] == ["a", "b", "x"]


def test_restricted_class(spark):
    cand = spark.createDataFrame([("1", ["b", "zz"]), ("2", ["b", "c"])], "org_id string, candidates array<string>")
    got = {r.org_id: (r.class_code, r.source, r.source_count) for r in decide.tag_restricted_class(scores(spark), cand).collect()}
    assert got == {"1": ("b", "only_one_tag", 1), "2": ("b", "ranked_tags", 2), "3": ("a", "all_classes", 2)}


def test_objective_checks_weights(spark):
    m = metrics.multilabel_metrics(eval_rows(spark))
    with pytest.raises(ValueError):
        aggregates.weighted_objective(m, {"f1_micro": 0.5})
    with pytest.raises(ValueError):
        aggregates.weighted_objective(m, {"f1_micro": 1.5, "f1_macro": -0.5})


def test_one_seed_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, m double")
    got = {r.k: (r.m_mean, r.m_std) for r in aggregates.grid_mean_std(df, ["k"], ["m"]).collect()}
    assert got["a"] == (1.0, None) and got["b"] == (2.0, pytest.approx(math.sqrt(2)))


def test_default_grid_sizes(spark):
    sizes = {r.grid_approach: r.n for r in grid.default_grid(spark).groupBy("grid_approach").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"ovr_logistic": 360, "ovr_sgd": 300, "hybrid_logistic": 1920, "hybrid_sgd": 1440}
    assert grid.param_grid(spark, "ovr_svc", fixed.APPROACH_GRIDS["ovr_svc"]).count() == 480
    assert grid.param_grid(spark, "hybrid_svc", fixed.APPROACH_GRIDS["hybrid_svc"]).count() == 360
    fits = grid.param_grid(spark, "ovr_logistic", fixed.APPROACH_GRIDS["ovr_logistic"]).select("fit_key").distinct().count()
    assert fits == 12


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([("1", ["a", "a", "b"]), ("2", ["a"]), ("3", [])], "org_id string, t array<string>")
    counts = features.term_counts(docs, "t", 1)
    n = docs.agg(F.count("*").alias("n"))
    got = {(r.org_id, r.term): r.weight for r in features.tfidf_l2(counts, n).collect()}
    a, b = 2 * (math.log(4 / 3) + 1), math.log(4 / 2) + 1
    assert got[("1", "a")] == pytest.approx(a / math.hypot(a, b))
    assert got[("2", "a")] == pytest.approx(1.0)
    assert {r.term for r in features.term_counts(docs, "t", 2).collect()} == {"a"}


def test_score_labels_in_blocks(spark, monkeypatch):
    terms = spark.createDataFrame([("1", "a", 0.5), ("1", "b", 2.0), ("2", "zz", 1.0)], "org_id string, term string, weight double")
    coefs = spark.createDataFrame([("a", "X", 1.0), ("b", "X", 0.5), ("a", "Y", -1.0)], "term string, code string, coef double")
    def run():
        return {(r.org_id, r.code): round(r.score, 9) for r in features.score_labels(terms, coefs, {"X": 0.5, "Y": 0.0}, "margin").collect()}
    plain = run()
    assert plain == {("1", "X"): 2.0, ("1", "Y"): -0.5, ("2", "X"): 0.5, ("2", "Y"): 0.0}
    monkeypatch.setattr(features, "BLOCK_COEFS", 1)
    assert run() == plain


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge", "modified_huber"])
def test_slopes_are_derivatives(loss):
    z = np.array([-3.0, -0.7, 0.3, 0.9, 2.0])
    f, d = linear.loss_and_slope(loss, z)
    up, _ = linear.loss_and_slope(loss, z + 1e-6)
    assert np.allclose((up - f) / 1e-6, d, atol=1e-4)


def test_margins_equal_dense_product(monkeypatch):
    monkeypatch.setattr(linear, "_BLOCK_VALUES", 7)
    rng = np.random.default_rng(0)
    dense = rng.random((9, 30)) * (rng.random((9, 30)) < 0.4)
    dense[3] = 0
    w, b = rng.random((30, 2)), rng.random(2)
    index = np.concatenate([np.flatnonzero(r) for r in dense])
    offsets = np.concatenate([[0], np.cumsum([(r != 0).sum() for r in dense])])
    assert np.allclose(linear.margins(index, dense[dense != 0], offsets, w, b), dense @ w + b)


def gold(spark):
    words = {"A1": "hospital nurse doctor clinic", "B2": "school pupil teacher lesson", "C3": "river forest bird lake"}
    rows = []
    for i in range(36):
        code = list(words)[i % 3]
        w = words[code].split()
        text = " ".join(w[(i + j) % 4] for j in range(3)) + f" shared words {i % 5}"
        rows.append((f"r{i:02d}", text, None, code + (";D4" if i % 6 == 0 else ""), code[0] + "10"))
    return spark.createDataFrame(rows, "org_id string, name string, activities string, tags string, class_code string")


LOGISTIC = models.Settings(model_c=10.0, threshold=0.4, min_df=1)


def test_logistic_optimum(spark):
    """The fitted coefficients have a vanishing gradient on the dense problem."""
    s = LOGISTIC
    g = grid.with_corpus(gold(spark), s.fields)
    m = models.train_final(g, s)
    assert m.labels == ["A1", "B2", "C3", "D4"]
    rows = models.featurise(m.text_of(g, "corpus"), "_text", s, m.features, ["tags"]).collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([1.0 if "A1" in r.tags else -1.0 for r in rows])
    d = -y / (1 + np.exp(y * (x @ m.coef[0] + m.intercept[0])))
    slope = x.T @ d / len(y) + m.coef[0] / (s.model_c * len(y))
    assert np.abs(slope).max() < 2e-4 and abs(d.mean()) < 2e-4


@pytest.mark.parametrize(
    "s",
    [
        models.Settings(model_family="linear_svc", model_c=1.0, threshold=0.0, class_weight_mode="balanced", char_ngram_max=3, min_df=1),
        models.Settings(model_family="sgd", sgd_loss="modified_huber", sgd_alpha=1e-3, threshold=0.5, min_df=1),
    ],
)
def test_separable_labels_are_learnt(spark, s, tmp_path):
    g = grid.with_corpus(gold(spark), s.fields)
    m = models.train_final(g, s)
    m.save(spark, str(tmp_path / "m"))
    back = models.OvrModel.load(spark, str(tmp_path / "m"))
    assert back.settings == s and back.labels == m.labels
    for r in back.predict(g, keep=["org_id", "tags"]).collect():
        assert r.tags.split(";")[0] in r.predicted_codes


def test_class_model_round_trip(spark, tmp_path):
    g = grid.with_corpus(gold(spark), fixed.DEFAULT_FIELDS)
    m = models.fit_class_lr(g, max_iter=50)
    m.save(spark, str(tmp_path / "c"))
    got = models.ClassModel.load(spark, str(tmp_path / "c")).predict(g, keep=["org_id"])
    truth = {r.org_id: r.class_code for r in g.collect()}
    assert all(truth[r.org_id] == r.class_code for r in got.collect())


def test_sweep_equals_one_setting_at_a_time(spark):
    values = {
        "model_family": ["logistic"], "threshold": [0.1, 0.5], "ngram_max": [1], "char_ngram_max": [0], "model_c": [1.0],
        "class_weight_mode": ["none"], "fallback_mode": ["top_k", "max_score_top_1"], "top_k_fallback": [0, 1], "fallback_min_score": [0.1],
    }
    params = grid.param_grid(spark, "ovr_logistic", values).unionByName(
        grid.param_grid(spark, "hybrid_logistic", {**values, "hybrid_label_confidence_threshold": [0.15]}))
    truth = spark.createDataFrame([("1", ["a"], ["c"]), ("2", ["b", "c"], ["b"]), ("3", [], ["a"])],
                                  "org_id string, true_codes array<string>, rule_codes array<string>")
    ranked = truth.join(decide.ranked_scores(scores(spark)), "org_id")
    rows = ranked.withColumns({"seed": F.lit(1), "fit_key": params.select("fit_key").distinct().scalar()})
    swept = grid.grid_sweep(rows, params).collect()
    assert len(swept) == 12
    for r in swept:
        if r.threshold != 0.5:
            continue
        codes = decide.decided(F.col("ranked"), r.threshold, r.fallback_mode, r.top_k_fallback, r.fallback_min_score)
        one = ranked.withColumn("model_codes", codes)
        if r.grid_approach.startswith("hybrid"):
            final = decide.combined(F.col("model_codes"), F.col("rule_codes"), F.col("ranked"), "label_conf_gated_regex",
                                    label_conf=r.hybrid_label_confidence_threshold)
            one = one.withColumn("model_codes", final)
        m = metrics.multilabel_metrics(one.withColumnRenamed("model_codes", "predicted_codes")).first()
        assert (m.f1_micro, m.hamming_loss, m.jaccard_samples) == (r.f1_micro, r.hamming_loss, r.jaccard_samples)


def test_no_settings_left_is_an_error(spark):
    summary = spark.createDataFrame([("ovr_logistic", 0.1)], "grid_approach string, f1_micro_mean double")
    summary = summary.withColumns({k: F.lit(None).cast("string") for k in fixed.GRID_KEYS[1:]})
    with pytest.raises(ValueError):
        grid.pick_best(summary, "f1_micro", specs=[("f1_micro", ">=", 0.4)])


def test_final_holdout_beside_rules(spark):
    rules = [Rule("A1", r"\b(nurse|doctor)\b")]
    dev, test = gold(spark).where("org_id < 'r24'"), gold(spark).where("org_id >= 'r24'")
    out = {r.approach: r for r in workflow.final_holdout(dev, test, rules, {"ovr_logistic": LOGISTIC}).collect()}
    assert set(out) == {"regex", "ovr_logistic"} and out["ovr_logistic"].f1_micro > out["regex"].f1_micro
    with pytest.raises(ValueError):
        workflow.final_holdout(dev, dev, rules, {})


def test_settings_are_checked():
    for bad in ({"ngram_max": 0}, {"char_ngram_max": 2}, {"model_c": 0.0}, {"class_weight_mode": "x"},
                {"fallback_mode": "x"}, {"model_family": "sgd"}, {"model_family": "x"}):
        with pytest.raises(ValueError):
            models.Settings(**bad)


def test_scores_in_blocks_of_labels(spark, monkeypatch):
    g = grid.with_corpus(gold(spark), LOGISTIC.fields)
    m = models.train_final(g, LOGISTIC)
    assert all(x["converged"] for x in m.info["steps"].values())
    whole = sorted(map(str, m.ranked(g).collect()))
    monkeypatch.setattr(models, "MAX_MATRIX_BYTES", 1)
    assert sorted(map(str, m.ranked(g).collect())) == whole


def test_a_fit_says_that_it_did_not_converge(spark):
    g = grid.with_corpus(gold(spark), LOGISTIC.fields)
    m = models.train_final(g, LOGISTIC)
    rows = models.featurise(m.text_of(g, "corpus"), "_text", LOGISTIC, m.features, ["tags"]).select(F.split("tags", ";").alias("labels"), "features")
    with pytest.warns(RuntimeWarning):
        *_, report = linear.fit_linear(rows, "logistic", 1e-3, max_iter=2)
    assert not any(x["converged"] for x in report.values())


def test_models_keep_their_base_forms(spark, tmp_path):
    g = grid.with_corpus(gold(spark), LOGISTIC.fields)
    lexicon = spark.createDataFrame([("nurse", "doctor"), ("clinic", "doctor"), ("hospital", "doctor")], "surface string, lemma string")
    m = models.train_final(g, LOGISTIC, lexicon=lexicon)
    assert "nurse" not in m.features.stages[0].vocabulary and "doctor" in m.features.stages[0].vocabulary
    m.save(spark, str(tmp_path / "lemmas"))
    back = models.OvrModel.load(spark, str(tmp_path / "lemmas"))
    assert back.lexicon.count() == 3
    assert sorted(map(str, back.ranked(g).collect())) == sorted(map(str, m.ranked(g).collect()))


def test_gold_texts_fill_from_objects(spark):
    from pyspark.sql import types as T

    from tagspark.plans import jobs

    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("reg_number", "name", "activities", "objects", "tags", "class_code")])
    raw = spark.createDataFrame([("r1", '{"reg_number": "1", "name": "x", "objects": "runs a hospital", "tags": ["A"]}')], "id string, fields string")
    row = grid.with_corpus(jobs.job_gold_sample(raw, kinds), fixed.DEFAULT_FIELDS).first()
    assert row.corpus == "x runs a hospital"


def test_stored_settings_train(spark, tmp_path):
    grid.save_best(spark, {"ovr_logistic": LOGISTIC}, str(tmp_path / "best"))
    m = workflow.train_stored(gold(spark).drop("objects"), str(tmp_path / "best"), "ovr_logistic")
    assert m.labels == ["A1", "B2", "C3", "D4"]

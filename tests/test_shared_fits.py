"""Approaches of one comparison that train alike share a fit."""

from test_batched_fits import gold

from tagspark.operators import linear, models, ranking, rules
from tagspark.plans import workflow


def test_approaches_that_train_alike_are_fitted_once(spark, monkeypatch):
    dev, test = ranking.split_holdout(gold(spark, 90), "org_id", 0.3, 5)
    base = {"clean_text": False, "min_df": 1, "model_c": 1.0, "threshold": 0.3}
    configs = {"ovr_logistic": models.Settings(**base), "hybrid_logistic": models.Settings(**{**base, "threshold": 0.4}, approach="hybrid_logistic", hybrid_conf=0.1),
               "ovr_other": models.Settings(**{**base, "model_c": 3.0})}
    listed = [rules.Rule("AA101", "care")]
    series, real = [], linear.fit_views
    monkeypatch.setattr(models, "fit_views", lambda views, *a, **k: series.append([len(v.targets) for v in views.values()]) or real(views, *a, **k))
    got = {r.approach: r for r in workflow.final_holdout(dev, test, listed, configs).collect()}
    assert series == [[8]]  # four codes, two ways of training; one fit for each approach took three series
    series.clear()
    for name, s in configs.items():
        alone = {r.approach: r for r in workflow.final_holdout(dev, test, listed, {name: s}).collect()}
        assert alone[name] == got[name]
    assert series == [[4]] * 3

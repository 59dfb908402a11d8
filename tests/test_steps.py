"""A workflow that was cut off goes on after its last finished step."""

import pytest
from pyspark.sql import functions as F
from test_batched_fits import gold

from tagspark.operators import linear, ranking, rules
from tagspark.plans import grid, workflow
from tagspark.plans.steps import Steps, table_digest


class Lost(Exception):
    pass


def test_a_cut_off_workflow_goes_on(spark, tmp_path, monkeypatch):
    dev, test = ranking.split_holdout(gold(spark, 90), "org_id", 0.3, 5)
    values = {"clean_text": [False], "model_family": ["logistic"], "threshold": [0.2, 0.4], "ngram_max": [1], "char_ngram_max": [0], "model_c": [1.0],
              "class_weight_mode": ["none"], "fallback_mode": ["top_k"], "top_k_fallback": [1], "fallback_min_score": [0.0]}
    params, listed = grid.param_grid(spark, "ovr_logistic", values), [rules.Rule("AA101", "care")]
    fits, real = [], linear.fit_views
    monkeypatch.setattr("tagspark.operators.models.fit_views", lambda *a, **k: fits.append(1) or real(*a, **k))
    steps = lambda: Steps(spark, str(tmp_path / "steps"))
    run = lambda s, p=params: workflow.full_workflow(dev, test, listed, p, seeds=[1], specs=[("f1_micro", ">=", 0.1)], steps=s)
    with monkeypatch.context() as m:
        m.setattr(grid, "grid_sweep", lambda *a: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            run(steps())
    assert len(fits) == 1
    with monkeypatch.context() as m:
        m.setattr(workflow, "final_holdout", lambda *a: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            run(steps())
    assert len(fits) == 1  # the search's fits were not made again
    second = steps()
    best, table = run(second)
    rows = sorted(map(str, table.collect()))
    assert second.made == ["final"] and len(fits) == 2 and len(rows) == 2
    third = steps()
    again, table = run(third)
    assert third.made == [] and again == best and sorted(map(str, table.collect())) == rows and len(fits) == 2
    # other thresholds are judged from the same scores; old steps can be removed
    fourth = steps()
    run(fourth, grid.param_grid(spark, "ovr_logistic", {**values, "threshold": [0.3]}))
    assert fourth.made[0] == "summary" and fourth.clean() >= 1 and Steps(spark, fourth.path).done(next(iter(k for k in fourth.used if k.startswith("scores"))))


def test_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    assert table_digest(a) == table_digest(a.repartition(3).orderBy(F.desc("k")))
    assert len({table_digest(x) for x in (a, a.limit(0), a.distinct(), a.withColumn("v", F.lit("x")))}) == 4


def test_unfinished_steps_are_made_again(spark, tmp_path):
    s = Steps(spark, str(tmp_path))
    key = s.key("rows", {"n": 1})
    spark.range(2).write.parquet(f"{tmp_path}/{key}")
    (tmp_path / key / "_SUCCESS").unlink()
    assert s.table("rows", {"n": 1}, lambda: spark.range(5)).count() == 5 and s.made == ["rows"]
    assert s.text("t", {}, lambda: "kept") == s.text("t", {}, lambda: "other") == "kept"
    assert Steps(spark, str(tmp_path)).clean() == 2

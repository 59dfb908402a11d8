"""Evaluation of rules, models and hybrids on held-out labelled records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.codes import code_set, split_codes
from tagspark.operators import aggregates, decide, joins, metrics, models, ranking, rules
from tagspark.plans import grid
from tagspark.plans.steps import Steps, table_digest


def labelled(stacked: DataFrame, label: str = "tags", id: str = "org_id") -> DataFrame:
    """Labelled rows, the first per record in stacking order."""
    rows = stacked.where(F.col(label).isNotNull())
    return ranking.dedupe_first(rows, [id]).drop("file_ord", "row_ord")


def make_split(
    gold: DataFrame, seed: int, test_size: float, id: str = "org_id"
) -> tuple[DataFrame, DataFrame, dict]:
    """Development and final test rows, and the numbers to record about them."""
    dev, test = ranking.split_holdout(gold, id, test_size, seed)
    joins.require_disjoint(dev, test, id)
    n_dev, n_test = dev.count(), test.count()
    info = {
        "seed": seed, "test_size": test_size, "labelled_rows": n_dev + n_test,
        "dev_rows": n_dev, "test_rows": n_test,
    }
    return dev, test, info


def rule_rows(gold: DataFrame, rule_list: Sequence[rules.Rule], include_groups: bool = False) -> DataFrame:
    return rules.tag_by_rules_eval(
        grid.with_corpus(gold, fixed.DEFAULT_FIELDS), rule_list, include_groups
    )


def model_rows(model: models.OvrModel, test: DataFrame) -> DataFrame:
    """Evaluation rows of a one-vs-rest model, scores kept beside them."""
    held = grid.with_corpus(test, model.settings.fields)
    truth = code_set(split_codes(F.col("tags")))
    out = model.predict(held.withColumn("true_codes", truth), keep=["org_id", "true_codes"])
    return out.withColumn("prediction_source", F.lit("ml_model_holdout_ovr"))


def hybrid_rows(
    model: models.OvrModel, test: DataFrame, rule_list: Sequence[rules.Rule], rule: str, label_conf: float,
    include_groups: bool = False,
) -> DataFrame:
    """Evaluation rows of a hybrid: rules and model read the same row, so nothing is joined."""
    held = grid.with_corpus(test, fixed.DEFAULT_FIELDS)
    sets = rules.tag_sets(held, rule_list, include_groups=include_groups, out="rule_codes").drop("corpus")
    truth = code_set(split_codes(F.col("tags")))
    rows = grid.with_corpus(sets, model.settings.fields).withColumn("true_codes", truth)
    out = model.predict(rows, keep=["org_id", "true_codes", "rule_codes"])
    final = decide.combined(F.col("predicted_codes"), F.col("rule_codes"), F.col("ranked"), rule, label_conf=label_conf)
    return out.select("org_id", "true_codes", final.alias("predicted_codes"), F.lit(f"hybrid_{rule}").alias("prediction_source"))


def _measured(eval_rows: DataFrame, approach: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    out = aggregates.weighted_objective(metrics.multilabel_metrics(eval_rows), weights)
    return out.select(F.lit(approach).alias("approach"), *out.columns)


def compare_evals(evals: Mapping[str, DataFrame]) -> DataFrame:
    """One row of metrics per approach, from their evaluation rows, in one job."""
    stacked = None
    for name, rows in evals.items():
        part = rows.select(F.lit(name).alias("approach"), "true_codes", "predicted_codes")
        stacked = part if stacked is None else stacked.unionByName(part)
    return aggregates.weighted_objective(metrics.multilabel_metrics(stacked, by=("approach",)))


def _approach_evals(
    train: DataFrame, test: DataFrame, rule_list: Sequence[rules.Rule], configs: Mapping[str, models.Settings],
    include_groups: bool = False,
) -> dict[str, DataFrame]:
    # approaches that only read their scores otherwise share a fit, and all fits are one series of jobs
    families: dict[tuple, dict[tuple, models.Settings]] = {}
    for s in configs.values():
        families.setdefault(models.feature_key(s), {}).setdefault(models.training_key(s), s)
    found = models.train_many({str(i): (grid.with_corpus(train, f[0]), list(fits.values())) for i, (f, fits) in enumerate(families.items())})
    made = {(f, k): m for (f, fits), own in zip(families.items(), found.values(), strict=True) for k, m in zip(fits, own, strict=True)}
    evals = {}
    for name, s in configs.items():
        model = replace(made[models.feature_key(s), models.training_key(s)], settings=s)
        if name.startswith("hybrid"):
            rows = hybrid_rows(
                model, test, rule_list, s.hybrid_rule or "label_conf_gated_regex",
                s.hybrid_conf if s.hybrid_conf is not None else fixed.HYBRID_LABEL_CONFIDENCE, include_groups,
            )
        else:
            rows = model_rows(model, test)
        evals[name] = rows
    return evals


def compare_approaches(
    gold: DataFrame, rule_list: Sequence[rules.Rule], configs: Mapping[str, models.Settings],
    seed: int = fixed.EVALUATION_SEED, test_size: float = fixed.TEST_SHARE,
    include_groups: bool = False,
) -> DataFrame:
    """Rules and every configured approach on one shared split."""
    dev, test = ranking.split_holdout(gold, "org_id", test_size, seed)
    dev, test = models.keep_for_fits(dev), models.keep_for_fits(test)
    by_rules = rule_rows(test, rule_list, include_groups)
    return compare_evals({"regex": by_rules, **_approach_evals(dev, test, rule_list, configs, include_groups)})


def eval_rules_full(
    gold: DataFrame, rule_list: Sequence[rules.Rule], include_groups: bool = False
) -> DataFrame:
    """Rules scored on all labelled rows."""
    return _measured(rule_rows(gold, rule_list, include_groups), "regex")


def eval_class_holdout(
    gold: DataFrame, seed: int = fixed.EVALUATION_SEED, test_size: float = fixed.TEST_SHARE,
    label: str = "class_code", max_iter: int = fixed.CLASS_MAX_ITER,
) -> DataFrame:
    """Row results of the class model on held-out rows, stratified if possible."""
    rows = gold.where(F.col(label).isNotNull())
    # The split and every pass of the fit read the labelled rows.
    rows = models.keep_for_fits(rows)
    if aggregates.can_stratify(rows, label):
        train, test = ranking.split_stratified(rows, "org_id", label, test_size, seed)
    else:
        train, test = ranking.split_holdout(rows, "org_id", test_size, seed)
    model = models.fit_class_lr(
        grid.with_corpus(train, fixed.DEFAULT_FIELDS), label=label, max_iter=max_iter
    )
    held = grid.with_corpus(test, fixed.DEFAULT_FIELDS).withColumn("y_true", F.col(label))
    out = model.predict(held, keep=["org_id", "y_true"])
    return out.select(
        "org_id", "y_true", F.col("class_code").alias("y_pred"),
        F.bround("class_code_probability", 4).alias("prediction_probability"),
        F.lit("ml_model_holdout").alias("prediction_source"),
    )


def eval_ovr_holdout(
    gold: DataFrame, settings: models.Settings, seed: int = fixed.EVALUATION_SEED,
    test_size: float = fixed.TEST_SHARE,
) -> DataFrame:
    """Row results of a one-vs-rest model on held-out rows."""
    dev, test = ranking.split_holdout(gold, "org_id", test_size, seed)
    dev, test = models.keep_for_fits(dev), models.keep_for_fits(test)
    model = models.train_final(grid.with_corpus(dev, settings.fields), settings)
    return model_rows(model, test)


def final_holdout(
    dev: DataFrame, test: DataFrame, rule_list: Sequence[rules.Rule],
    best: Mapping[str, models.Settings], include_groups: bool = False,
) -> DataFrame:
    """Refit the best settings on the development rows, score the untouched
    test rows once, always beside the rules."""
    joins.require_disjoint(dev, test)
    dev, test = models.keep_for_fits(dev), models.keep_for_fits(test)
    by_rules = rule_rows(test, rule_list, include_groups)
    return compare_evals({"regex": by_rules, **_approach_evals(dev, test, rule_list, best, include_groups)})


def train_stored(
    gold: DataFrame, path: str, approach: str, lexicon: DataFrame | None = None
) -> models.OvrModel:
    """Fit the stored settings of an approach on all labelled rows."""
    s = grid.load_best(gold.sparkSession, path)[approach]
    return models.train_final(grid.with_corpus(gold, s.fields), s, lexicon=lexicon)


def final_holdout_stored(
    dev: DataFrame, test: DataFrame, rule_list: Sequence[rules.Rule], path: str, include_groups: bool = False
) -> DataFrame:
    """:func:`final_holdout` of the stored settings."""
    return final_holdout(dev, test, rule_list, grid.load_best(dev.sparkSession, path), include_groups)


def full_workflow(
    dev: DataFrame, test: DataFrame, rule_list: Sequence[rules.Rule], params: DataFrame,
    seeds: Sequence[int] = tuple(fixed.GRID_SEEDS), metric: str = "weighted_primary",
    specs=tuple(fixed.GUARDRAILS), test_size: float = fixed.TEST_SHARE, store: str | None = None,
    steps: Steps | None = None,
) -> tuple[dict[str, models.Settings], DataFrame]:
    """Search on the development rows, then judge the winners on the test rows.

    With ``store``, the winners are saved there, and what is judged is what was read back. With ``steps``, the scores of all
    fits, the summary and the final table are kept as steps, under digests of the rows, rules and settings they depend on; run again, the
    workflow goes on after the last step that was finished, and ``steps.clean()`` removes what it no longer needs.
    """
    if steps is None:
        summary = grid.summarise(grid.run_grid(dev, rule_list, params, seeds, test_size))
    else:
        fits = params.dropDuplicates(["fit_key"]).select("fit_key")
        searched = {
            "rows": table_digest(dev.select("org_id", "name", "activities", "objects", "tags")), "rules": [(r.code, r.include, r.exclude) for r in rule_list],
            "fits": table_digest(fits), "seeds": list(seeds), "test_size": test_size,
        }
        scored = steps.table("scores", searched, lambda: grid.score_fits(dev, rule_list, params, seeds, test_size))
        searched["settings"] = table_digest(params)
        summary = steps.table("summary", searched, lambda: grid.summarise(grid.grid_sweep(scored, params)))
    best = grid.pick_best(summary, metric, specs=specs)
    if store is not None:
        grid.save_best(dev.sparkSession, best, store)
        best = grid.load_best(dev.sparkSession, store)
    if steps is None:
        return best, final_holdout(dev, test, rule_list, best)
    judged = {**searched, "test": table_digest(test.select("org_id", "name", "activities", "objects", "tags")), "best": {k: repr(v) for k, v in best.items()}}
    return best, steps.table("final", judged, lambda: final_holdout(dev, test, rule_list, best))

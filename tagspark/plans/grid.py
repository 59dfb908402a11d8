"""Search over settings: fit each training key once, then judge all settings in one job."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark import fixed, schema
from tagspark.operators import aggregates, decide, metrics, models, ranking, rules
from tagspark.session import shared_folder

#: Settings that meet the scores in one broadcast; more are swept block by block.
BLOCK_SETTINGS = 50_000
_DEFAULTS = {
    "fields_key": [",".join(fixed.DEFAULT_FIELDS)],
    "clean_text": [True],
    "model_c": [-1.0],
    "sgd_loss": [""],
    "sgd_alpha": [-1.0],
    "hybrid_label_confidence_threshold": [-1.0],
}
_TYPES = {
    "threshold": "double", "ngram_max": "int", "char_ngram_max": "int", "model_c": "double",
    "sgd_alpha": "double", "fallback_min_score": "double", "top_k_fallback": "int",
    "hybrid_label_confidence_threshold": "double", "clean_text": "boolean",
}


def param_grid(
    spark: SparkSession, approach: str, values: Mapping[str, Sequence | DataFrame]
) -> DataFrame:
    """Every combination of settings, one row each, with ``fit_key``.

    A value list may also be a one-column table of (few) distinct values. The
    fallback number goes with its own mode only: ``top_k`` varies
    ``top_k_fallback``, ``max_score_top_1`` varies ``fallback_min_score``.
    """
    def listed(key: str):
        given = values.get(key, _DEFAULTS.get(key))
        if given is None:
            raise ValueError(f"no values for {key}")
        kind = _TYPES.get(key, "string")
        if isinstance(given, DataFrame):
            col = given.columns[0]
            found = F.array_sort(F.collect_set(F.col(col).cast(kind)))
            return given.agg(found.alias("v")).scalar()
        return F.array(*[F.lit(v).cast(kind) for v in given])

    rows = spark.range(1).select(F.lit(approach).alias("grid_approach"))
    paired = ("fallback_mode", "fallback_min_score", "top_k_fallback")
    for key in fixed.GRID_KEYS[1:]:
        if key not in paired:
            rows = rows.select("*", F.explode(listed(key)).alias(key))
    rows = rows.select("*", F.explode(listed("fallback_mode")).alias("fallback_mode"))
    mode = F.col("fallback_mode")
    ks = F.when(mode == "top_k", listed("top_k_fallback")).otherwise(F.array(F.lit(0)))
    mins = F.when(mode == "max_score_top_1", listed("fallback_min_score")).otherwise(F.array(F.lit(0.0)))
    rows = rows.select("*", F.explode(ks).alias("top_k_fallback"))
    rows = rows.select("*", F.explode(mins).alias("fallback_min_score"))
    return with_keys(rows.select(*fixed.GRID_KEYS))


def with_keys(params: DataFrame) -> DataFrame:
    """Add ``fit_key`` (what the fit depends on) and ``setting`` (all of it)."""
    def text(cols: Sequence[str]):
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])

    return params.withColumn("fit_key", F.md5(text(fixed.FIT_KEYS))).withColumn(
        "setting", F.md5(text(fixed.GRID_KEYS))
    )


def default_grid(spark: SparkSession, approaches: Sequence[str] = tuple(fixed.DEFAULT_APPROACHES)) -> DataFrame:
    out = None
    for name in approaches:
        grid = param_grid(spark, name, fixed.APPROACH_GRIDS[name])
        out = grid if out is None else out.unionByName(grid)
    return out


def grid_sweep(
    scored: DataFrame, params: DataFrame, hybrid_rule: str = "label_conf_gated_regex"
) -> DataFrame:
    """Metrics of every seed and setting, in one job.

    ``scored`` holds one row per seed, fit and record: ``seed, fit_key,
    org_id, true_codes, rule_codes, ranked``. Settings meet the scores of
    their own fit by an equi-join with the (counted, small) settings table;
    decisions are made inside the row and counters are summed per task, so the
    shuffle carries seeds x settings x codes rows, not records.

    Action: counts the settings. More than ``BLOCK_SETTINGS`` are dealt into blocks by their key, each a
    broadcast of bounded size.
    """
    blocks = -(-params.count() // BLOCK_SETTINGS)
    out = None
    for i in range(max(1, blocks)):
        own = params if blocks < 2 else params.where(F.pmod(F.xxhash64("setting"), F.lit(blocks)) == i)
        part = _sweep(scored, own, hybrid_rule)
        out = part if out is None else out.unionByName(part)
    return out


def _sweep(scored: DataFrame, params: DataFrame, hybrid_rule: str) -> DataFrame:
    knobs = params.select(
        "fit_key", "setting", "grid_approach", "threshold", "fallback_mode",
        "fallback_min_score", "top_k_fallback", "hybrid_label_confidence_threshold",
    )
    tried = scored.join(F.broadcast(knobs), "fit_key")
    model_codes = decide.decided(
        F.col("ranked"), F.col("threshold"), F.col("fallback_mode"), F.col("top_k_fallback"),
        F.col("fallback_min_score"),
    )
    rows = tried.select(
        "seed", "setting", "grid_approach", "true_codes", "rule_codes", "ranked",
        "hybrid_label_confidence_threshold", model_codes.alias("model_codes"),
    )
    hybrid = decide.combined(
        F.col("model_codes"), F.col("rule_codes"), F.col("ranked"), hybrid_rule,
        label_conf=F.col("hybrid_label_confidence_threshold"),
    )
    final = F.when(F.startswith("grid_approach", F.lit("hybrid")), hybrid).otherwise(F.col("model_codes"))
    judged = rows.select("seed", "setting", "true_codes", final.alias("predicted_codes"))
    measured = metrics.multilabel_metrics(judged, by=("seed", "setting"))
    return aggregates.weighted_objective(measured).join(
        params.select("setting", *fixed.GRID_KEYS), "setting"
    )


#: Column of the grid -> field of the settings and how its value is read.
_FIELDS = {
    "fields_key": ("fields", lambda v: tuple(x for x in v.split(",") if x)),
    "hybrid_label_confidence_threshold": ("hybrid_conf", lambda v: v if v >= 0 else None),
    "sgd_loss": ("sgd_loss", lambda v: v or None),
    "sgd_alpha": ("sgd_alpha", lambda v: v if v > 0 else None),
    "grid_approach": ("approach", str),
}


def settings_of(row, **extra) -> models.Settings:
    """Model settings out of a row of the grid: absent values stand as -1 or empty text there."""
    given = {}
    for column in fixed.GRID_KEYS:
        name, read = _FIELDS.get(column, (column, lambda v: v))
        given[name] = None if row[column] is None else read(row[column])
    return models.Settings(**given, **extra)


def settings_row(s: models.Settings) -> dict:
    """Settings as a row of ``schema.BEST_SETTINGS``."""
    return {name: ",".join(s.fields) if name == "fields_key" else getattr(s, name) for name in schema.BEST_SETTINGS.fieldNames()}


def save_best(spark: SparkSession, best: Mapping[str, models.Settings], path: str) -> None:
    """Chosen settings, one row per approach."""
    rows = [tuple(settings_row(s).values()) for _, s in sorted(best.items())]
    out = spark.createDataFrame(rows, schema.BEST_SETTINGS).coalesce(1)
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_best(spark: SparkSession, path: str) -> dict[str, models.Settings]:
    """Stored settings by approach, ready to train and judge with."""
    found = {}
    for row in spark.read.schema(schema.BEST_SETTINGS).json(path).collect():
        given = row.asDict()
        fields = tuple(x for x in given.pop("fields_key").split(",") if x)
        found[row["approach"]] = models.Settings(fields=fields, **given)
    return found


def with_corpus(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    from tagspark.functions.text import text_corpus

    return text_corpus(df, list(fields))


def score_fits(
    gold: DataFrame, rule_list: Sequence[rules.Rule], params: DataFrame, seeds: Sequence[int],
    test_size: float = fixed.TEST_SHARE, include_groups: bool = False,
) -> DataFrame:
    """Fit every training key for every seed; scores of the held-out rows.

    All fits of all seeds are one series of jobs (``linear.fit_views``); texts are turned into features, and scored, once for each seed and
    way of making features. Settings that only change how scores are read do not cause a fit.
    """
    spark = gold.sparkSession
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    keys = params.dropDuplicates(["fit_key"]).orderBy("fit_key").collect()
    families: dict[tuple, list] = {}
    for row in keys:
        s = settings_of(row)
        families.setdefault(models.feature_key(s), []).append((row["fit_key"], s))
    if not keys:
        raise ValueError("no settings to fit")
    devs, tests, named = [], {}, {}
    for seed in seeds:
        dev, test = ranking.split_holdout(gold, "org_id", test_size, seed)
        judged = rules.tag_by_rules_eval(with_corpus(test, fixed.DEFAULT_FIELDS), rule_list, include_groups)
        codes = judged.select("org_id", "true_codes", F.col("predicted_codes").alias("rule_codes"))
        # rules run once per seed; their codes travel beside the texts through every fit
        dev, tests[seed] = models.keep_for_fits(dev), models.keep_for_fits(test.join(codes, "org_id"))
        devs.append(dev)
        for i, (family, fits) in enumerate(families.items()):
            named[f"{seed}/{i}"] = with_corpus(dev, family[0]), [s for _, s in fits]
    fitted = models.train_many(named)
    for name, found in fitted.items():
        seed, i = name.split("/")
        family, fits = list(families.items())[int(i)]
        held = with_corpus(tests[int(seed)], family[0])
        ranked = models.ranked_many(found, [k for k, _ in fits], held, keep=["org_id", "true_codes", "rule_codes"])
        # written part by part: the plan of the sweep does not grow with their number
        rows = ranked.select(F.lit(int(seed)).alias("seed"), F.col("name").alias("fit_key"), "org_id", "true_codes", "rule_codes", "ranked")
        rows.write.mode("append").parquet(path)
    models.release(*devs, *tests.values())
    return spark.read.parquet(path)


def run_grid(
    gold: DataFrame, rule_list: Sequence[rules.Rule], params: DataFrame,
    seeds: Sequence[int] = tuple(fixed.GRID_SEEDS), test_size: float = fixed.TEST_SHARE,
    hybrid_rule: str = "label_conf_gated_regex", include_groups: bool = False,
) -> DataFrame:
    """Metrics per seed and setting for labelled records."""
    scored = score_fits(gold, rule_list, params, seeds, test_size, include_groups)
    return grid_sweep(scored, params, hybrid_rule)


def summarise(per_state: DataFrame) -> DataFrame:
    names = [*fixed.METRICS, "weighted_primary", "rows"]
    return aggregates.grid_mean_std(per_state, fixed.GRID_KEYS, names)


def pick_best(
    summary: DataFrame, metric: str = "weighted_primary", approaches: Sequence[str] | None = None,
    specs=tuple(fixed.GUARDRAILS), hybrid_rule: str = "label_conf_gated_regex",
    include_groups: bool = False,
) -> dict[str, models.Settings]:
    """Best settings per approach that pass the guardrails.

    Action: fetches one row per approach. Fails when an approach has none left.
    """
    best = best_rows(summary, metric, approaches, specs)
    found = {}
    for row in best.collect():
        name = row["grid_approach"]
        found[name] = settings_of(
            row, selected_by=f"{name}_{metric}_mean", include_groups=include_groups,
            hybrid_rule=hybrid_rule if name.startswith("hybrid") else None,
        )
    missing = [a for a in approaches or [] if a not in found]
    if missing or not found:
        raise ValueError(f"no settings left after guardrails for {missing or 'any approach'}")
    return found


def best_rows(
    summary: DataFrame, metric: str, approaches: Sequence[str] | None = None,
    specs=tuple(fixed.GUARDRAILS),
) -> DataFrame:
    rows = summary if approaches is None else summary.where(F.col("grid_approach").isin(list(approaches)))
    ok = aggregates.guardrails(rows, specs)
    ranked = ranking.rank_settings(ok, f"{metric}_mean", tie=fixed.GRID_KEYS[1:])
    return ranked.where("rank = 1").drop("rank")

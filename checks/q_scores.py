"""Features, scores, decisions and settings search with fixed coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    METRIC_COLS,
    METRIC_SQL,
    OBJECTIVE_SQL,
    RULES,
    class_scores,
    eval_rows,
    gold,
    metrics_sql,
    query,
    rows6,
    score_lists,
    scores,
    table,
    tags,
    taxonomy,
    term_table,
    weights,
    with_ctes,
)
from tagspark.functions.codes import join_codes
from tagspark.operators import decide, features, joins, ranking, rules
from tagspark.plans import grid, workflow


@query("term_counts", "SELECT org_id, term, tf, df FROM term_table", ("term_table",))
def term_counts(spark, sf):
    return term_table(spark, sf)


@query("tfidf_l2", "SELECT org_id, term, round(weight, 6) AS weight FROM weights", ("weights",))
def tfidf_l2(spark, sf):
    return rows6(weights(spark, sf), "weight").select("org_id", "term", "weight")


@query("label_binarise", "SELECT org_id, code AS label FROM truth", ("truth",))
def label_binarise(spark, sf):
    return features.label_binarise(gold(spark, sf))


_CW = """SELECT code AS label, count(*) AS n_label, round(n / (2.0 * count(*)), 6) AS positive, round(n / nullif(2.0 * (n - count(*)), 0), 6) AS negative
  FROM truth, (SELECT count(*) AS n FROM gold) GROUP BY code, n"""


@query("class_weights", _CW, ("truth", "gold"))
def class_weights(spark, sf):
    g = gold(spark, sf)
    n = g.agg(F.count(F.lit(1)).alias("n"))
    return rows6(features.class_weights(features.label_binarise(g), n), "positive", "negative")


@query("score_labels", "SELECT org_id, code, round(score, 6) AS score FROM scores", ("scores",))
def score_labels(spark, sf):
    return rows6(scores(spark, sf), "score")


def _decided_sql(fallback: str) -> str:
    return f"""SELECT r.org_id, coalesce(string_agg(s.code, ';' ORDER BY s.code), '') AS codes FROM records r
      LEFT JOIN ranks s ON s.org_id = r.org_id AND (s.score >= 0.2 OR (s.best < 0.2 AND {fallback})) GROUP BY r.org_id"""


def _joined(df, col="predicted_codes"):
    return df.select("org_id", join_codes(F.col(col)).alias("codes"))


@query("decide_threshold", _decided_sql("false"), ("records", "ranks"))
def decide_threshold(spark, sf):
    return _joined(decide.decide_threshold(score_lists(spark, sf), 0.2))


@query("decide_top_k", _decided_sql("s.rn <= 2"), ("records", "ranks"))
def decide_top_k(spark, sf):
    return _joined(decide.decide_top_k(score_lists(spark, sf), 0.2, 2))


@query("decide_max_score", _decided_sql("s.rn = 1 AND s.score >= 0.14"), ("records", "ranks"))
def decide_max_score(spark, sf):
    return _joined(decide.decide_max_score(score_lists(spark, sf), 0.2, 0.14))


def _hybrid_sql(add: str) -> str:
    return f"""SELECT r.org_id, coalesce((SELECT string_agg(DISTINCT u.code, ';' ORDER BY u.code) FROM
      (SELECT code FROM ranks m WHERE m.org_id = r.org_id AND m.score >= 0.2
       UNION SELECT t.code FROM tags t LEFT JOIN ranks s ON s.org_id = t.org_id AND s.code = t.code
         WHERE t.org_id = r.org_id AND ({add})) u), '') AS codes FROM records r"""


def _aligned(spark, sf):
    """One ranked list per record with its rule codes beside it."""
    from checks.base import corpus

    by_rules = rules.tag_sets(corpus(spark, sf), RULES, out="rule_codes").select("org_id", "rule_codes")
    lists = score_lists(spark, sf).withColumn("model_codes", decide.decided(F.col("ranked"), 0.2))
    return lists.join(by_rules, "org_id")


@query("hybrid_fallback", _hybrid_sql("(SELECT count(*) FROM ranks c WHERE c.org_id = r.org_id AND c.score >= 0.2) <= 1"), ("records", "ranks", "tags"))
def hybrid_fallback(spark, sf):
    return _joined(decide.hybrid_fallback(_aligned(spark, sf)))


@query("hybrid_high_conf", _hybrid_sql("(SELECT max(score) FROM ranks c WHERE c.org_id = r.org_id) >= 0.25"), ("records", "ranks", "tags"))
def hybrid_high_conf(spark, sf):
    return _joined(decide.hybrid_high_conf(_aligned(spark, sf)))


@query("hybrid_gated", _hybrid_sql("coalesce(s.score, 0) >= 0.12"), ("records", "ranks", "tags"))
def hybrid_gated(spark, sf):
    return _joined(decide.hybrid_gated(_aligned(spark, sf), label_conf=0.12))


_RESTRICTED = """,
cand AS (SELECT DISTINCT t.org_id, trim(x.c) AS code FROM tags t JOIN (SELECT code, unnest(string_split(related, ';')) AS c FROM taxonomy) x ON t.code = x.code
  WHERE trim(x.c) <> ''),
open_ranks AS (SELECT c.*, row_number() OVER (PARTITION BY c.org_id ORDER BY score DESC, c.code) AS r2, count(*) OVER (PARTITION BY c.org_id) AS k
  FROM class_ranks c JOIN cand ON cand.org_id = c.org_id AND cand.code = c.code)
SELECT f.org_id, coalesce(o.code, f.code) AS class_code, round(coalesce(o.score, f.score), 6) AS score,
  CASE WHEN o.k = 1 THEN 'only_one_tag' WHEN o.k IS NULL THEN 'all_classes' ELSE 'ranked_tags' END AS source,
  coalesce(o.k, 4)::INTEGER AS source_count, f.code AS original_class_code, round(f.score, 6) AS original_max_score
  FROM class_ranks f LEFT JOIN open_ranks o ON o.org_id = f.org_id AND o.r2 = 1 WHERE f.rn = 1"""


@query("tag_restricted_class", with_ctes("", ("class_ranks", "tags", "taxonomy")).rstrip() + _RESTRICTED)
def tag_restricted_class(spark, sf):
    cand = rules.related_codes(tags(spark, sf), taxonomy(spark))
    return rows6(decide.tag_restricted_class(class_scores(spark, sf), cand), "score", "original_max_score")


# --- naive Bayes: labelled records train, every record is classified -------------
_NB = """,
train AS (SELECT t.org_id, t.term, t.tf, g.class_code FROM term_table t JOIN gold g ON t.org_id = g.org_id),
seen AS (SELECT class_code, term, sum(tf) AS c FROM train GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM seen),
cls AS (SELECT d.class_code, ln(d.n * 1.0 / sum(d.n) OVER ()) AS prior, ln(t.total + (SELECT count(*) FROM vocab)) AS floor FROM
  (SELECT class_code, count(*) AS n FROM gold GROUP BY 1) d JOIN (SELECT class_code, sum(c) AS total FROM seen GROUP BY 1) t ON d.class_code = t.class_code)
SELECT x.org_id, k.class_code AS code, round(any_value(k.prior) + sum(x.tf * (ln(coalesce(s.c, 0) + 1) - k.floor)), 4) AS score
  FROM term_table x JOIN vocab v ON x.term = v.term CROSS JOIN cls k LEFT JOIN seen s ON s.term = x.term AND s.class_code = k.class_code
  GROUP BY x.org_id, k.class_code"""


@query("naive_bayes_sql", with_ctes("", ("term_table", "gold")).rstrip() + _NB)
def naive_bayes_sql(spark, sf):
    terms = term_table(spark, sf, keep_part=True).drop("df")
    labels = gold(spark, sf).select("org_id", F.col("class_code").alias("label"))
    out = features.naive_bayes_sql(terms, labels, terms)
    return out.withColumn("score", F.round("score", 4))


_TWO_STEP = """,
train AS (SELECT t.org_id, t.term, t.tf, g.class_code, substr(g.class_code, 1, 1) AS section FROM term_table t JOIN gold g ON t.org_id = g.org_id),
s_seen AS (SELECT section, term, sum(tf) AS c FROM train GROUP BY ALL),
s_vocab AS (SELECT DISTINCT term FROM s_seen),
s_cls AS (SELECT d.section, ln(d.n * 1.0 / sum(d.n) OVER ()) AS prior, ln(t.total + (SELECT count(*) FROM s_vocab)) AS floor FROM
  (SELECT substr(class_code, 1, 1) AS section, count(*) AS n FROM gold GROUP BY 1) d JOIN (SELECT section, sum(c) AS total FROM s_seen GROUP BY 1) t USING (section)),
s_score AS (SELECT x.org_id, k.section, any_value(k.prior) + sum(x.tf * (ln(coalesce(s.c, 0) + 1) - k.floor)) AS score
  FROM term_table x JOIN s_vocab v ON x.term = v.term CROSS JOIN s_cls k LEFT JOIN s_seen s ON s.term = x.term AND s.section = k.section GROUP BY ALL),
picked AS (SELECT org_id, section FROM s_score QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY score DESC, section) = 1),
c_seen AS (SELECT section, class_code, term, sum(tf) AS c FROM train GROUP BY ALL),
c_vocab AS (SELECT DISTINCT section, term FROM c_seen),
c_cls AS (SELECT d.section, d.class_code, ln(d.n * 1.0 / sum(d.n) OVER (PARTITION BY d.section)) AS prior, ln(t.total + v.size) AS floor FROM
  (SELECT substr(class_code, 1, 1) AS section, class_code, count(*) AS n FROM gold GROUP BY ALL) d
  JOIN (SELECT section, class_code, sum(c) AS total FROM c_seen GROUP BY ALL) t USING (section, class_code)
  JOIN (SELECT section, count(*) AS size FROM c_vocab GROUP BY 1) v USING (section)),
c_score AS (SELECT x.org_id, p.section, k.class_code, any_value(k.prior) + sum(x.tf * (ln(coalesce(s.c, 0) + 1) - k.floor)) AS score
  FROM term_table x JOIN picked p USING (org_id) JOIN c_vocab v ON v.section = p.section AND v.term = x.term JOIN c_cls k ON k.section = p.section
  LEFT JOIN c_seen s ON s.term = x.term AND s.section = p.section AND s.class_code = k.class_code GROUP BY ALL)
SELECT org_id, section, class_code FROM c_score QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY score DESC, class_code) = 1"""


@query("two_step_counting", with_ctes("", ("term_table", "gold")).rstrip() + _TWO_STEP)
def two_step_counting(spark, sf):
    from tagspark.operators import models

    terms = term_table(spark, sf, keep_part=True).drop("df")
    return models.two_step_counting(terms, gold(spark, sf).select("org_id", "class_code"), terms)


# --- settings search ---------------------------------------------------------------
THRESHOLDS, KS, MINS, GATES = [0.13, 0.2, 0.35], [0, 1], [0.125, 0.15], [0.12, 0.2]
_GRID_VALUES = {
    "model_family": ["logistic"], "threshold": THRESHOLDS, "ngram_max": [1], "char_ngram_max": [0],
    "model_c": [10.0], "class_weight_mode": ["none"], "fallback_mode": ["top_k", "max_score_top_1"],
    "top_k_fallback": KS, "fallback_min_score": MINS,
}


def params(spark):
    ovr = grid.param_grid(spark, "ovr_logistic", _GRID_VALUES)
    hyb = grid.param_grid(
        spark, "hybrid_logistic", {**_GRID_VALUES, "hybrid_label_confidence_threshold": GATES}
    )
    return ovr.unionByName(hyb)


@query("param_grid", """SELECT l_discount AS threshold, l_linenumber AS ngram_max, mode AS fallback_mode, k AS top_k_fallback, m AS fallback_min_score
  FROM (SELECT DISTINCT l_discount FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linenumber FROM lineitem) CROSS JOIN
  (SELECT 'top_k' AS mode, CAST(k AS INTEGER) AS k, 0.0::DOUBLE AS m FROM (SELECT DISTINCT quality AS k FROM labels)
   UNION ALL SELECT 'max_score_top_1', 0, m FROM (SELECT DISTINCT l_tax AS m FROM lineitem)
   UNION ALL SELECT 'none', 0, 0.0)""")
def param_grid(spark, sf):
    li = table(spark, sf, "lineitem")
    given = {
        "model_family": ["logistic"], "threshold": li.select("l_discount"), "ngram_max": li.select("l_linenumber"),
        "char_ngram_max": [0], "class_weight_mode": ["none"], "fallback_mode": ["top_k", "max_score_top_1", "none"],
        "top_k_fallback": table(spark, sf, "labels").select("quality"), "fallback_min_score": li.select("l_tax"),
    }
    out = grid.param_grid(spark, "ovr_logistic", given)
    return out.select("threshold", "ngram_max", "fallback_mode", "top_k_fallback", "fallback_min_score")


def scored_rows(spark, sf):
    """Held-out labelled records of two seeds with their fixed scores."""
    g = gold(spark, sf)
    key = params(spark).select("fit_key").distinct().scalar()
    ev = rules.tag_by_rules_eval(g, RULES).select("org_id", "true_codes", F.col("predicted_codes").alias("rule_codes"))
    rows = ev.join(score_lists(spark, sf), "org_id").withColumn("fit_key", key)
    ids = g.select("org_id")
    picked = None
    for seed in (42, 67):
        test = ranking.split_holdout(ids, "org_id", 0.5, seed)[1].withColumn("seed", F.lit(seed))
        picked = test if picked is None else picked.unionByName(test)
    return rows.join(picked, "org_id")


def _settings_values() -> str:
    rows = []
    for approach, gates in (("ovr_logistic", [-1.0]), ("hybrid_logistic", GATES)):
        for t in THRESHOLDS:
            for h in gates:
                rows += [(approach, t, h, "top_k", k, 0.0) for k in KS]
                rows += [(approach, t, h, "max_score_top_1", 0, m) for m in MINS]
    body = ", ".join(f"({i}, '{a}', {t}::DOUBLE, {h}::DOUBLE, '{f}', {k}, {m}::DOUBLE)" for i, (a, t, h, f, k, m) in enumerate(rows))
    return f"SELECT * FROM (VALUES {body}) AS v(sid, grid_approach, threshold, gate, mode, k, m)"


def _sweep_head() -> str:
    return with_ctes("", ("gold", "truth", "tags", "ranks")).rstrip() + f""",
settings AS ({_settings_values()}),
held AS (SELECT s AS seed, org_id FROM (SELECT s, org_id, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || org_id)) <= ceil(count(*) OVER (PARTITION BY s) * 0.5) AS t
  FROM gold, (SELECT unnest([42, 67]) AS s)) WHERE t),
members AS (SELECT h.seed || '/' || sid AS run, org_id, sid FROM held h, settings),
runs AS (SELECT DISTINCT run, sid FROM members),
guess AS (SELECT m.run, m.org_id, r.code FROM members m JOIN settings p USING (sid) JOIN ranks r ON r.org_id = m.org_id
    AND (r.score >= threshold OR (r.best < threshold AND ((mode = 'top_k' AND r.rn <= k) OR (mode = 'max_score_top_1' AND r.rn = 1 AND r.score >= p.m))))
  UNION SELECT m.run, m.org_id, t.code FROM members m JOIN settings p USING (sid) JOIN tags t ON t.org_id = m.org_id
    LEFT JOIN ranks r ON r.org_id = t.org_id AND r.code = t.code WHERE grid_approach = 'hybrid_logistic' AND coalesce(r.score, 0) >= gate),
facts AS (SELECT m.run, m.org_id, t.code FROM members m JOIN truth t ON m.org_id = t.org_id),
""" + metrics_sql("members", "facts", "guess", "run")


_STATE = f"""SELECT split_part(run, '/', 1)::INTEGER AS seed, grid_approach, threshold, gate AS hybrid_label_confidence_threshold, mode AS fallback_mode, k AS top_k_fallback,
  m AS fallback_min_score, {{0}} rows, {OBJECTIVE_SQL} AS weighted_primary FROM measured JOIN runs USING (run) JOIN settings USING (sid)"""
_KNOBS = ["grid_approach", "threshold", "hybrid_label_confidence_threshold", "fallback_mode", "top_k_fallback", "fallback_min_score"]


@query("grid_sweep", _sweep_head() + "\n" + _STATE.format(METRIC_SQL + ",").replace(f"{OBJECTIVE_SQL} AS", f"round({OBJECTIVE_SQL}, 6) AS"))
def grid_sweep(spark, sf):
    out = grid.grid_sweep(scored_rows(spark, sf), params(spark))
    return rows6(out, *METRIC_COLS, "weighted_primary").select("seed", *_KNOBS, *METRIC_COLS, "rows", "weighted_primary")


@query("pick_best", _sweep_head() + f""",
state AS ({_STATE.format('f1_micro, f1_macro,')}),
summary AS (SELECT grid_approach, threshold, hybrid_label_confidence_threshold, fallback_mode, top_k_fallback, fallback_min_score,
  round(avg(weighted_primary), 6) AS weighted_primary_mean, round(stddev_samp(weighted_primary), 6) AS weighted_primary_std, avg(f1_micro) AS f FROM state GROUP BY ALL)
SELECT * EXCLUDE (f) FROM summary WHERE f >= 0.3
QUALIFY row_number() OVER (PARTITION BY grid_approach ORDER BY weighted_primary_mean DESC, threshold, fallback_mode, fallback_min_score, top_k_fallback, hybrid_label_confidence_threshold) = 1""")
def pick_best(spark, sf):
    per_state = grid.grid_sweep(scored_rows(spark, sf), params(spark))
    summary = rows6(grid.summarise(per_state), "weighted_primary_mean", "weighted_primary_std")
    best = grid.best_rows(summary, "weighted_primary", specs=[("f1_micro", ">=", 0.3)])
    return best.select(*_KNOBS, "weighted_primary_mean", "weighted_primary_std")


_COMPARE = with_ctes("", ("gold", "truth", "tags", "ranks")).rstrip() + """,
members AS (SELECT a AS approach, org_id FROM gold, (SELECT unnest(['regex', 'ovr_logistic', 'hybrid_logistic']) AS a)),
facts AS (SELECT m.approach, m.org_id, t.code FROM members m JOIN truth t ON m.org_id = t.org_id),
guess AS (SELECT 'regex' AS approach, org_id, code FROM tags WHERE org_id IN (SELECT org_id FROM gold)
  UNION ALL SELECT 'ovr_logistic', org_id, code FROM ranks WHERE org_id IN (SELECT org_id FROM gold) AND score >= 0.2
  UNION ALL (SELECT 'hybrid_logistic', org_id, code FROM ranks WHERE org_id IN (SELECT org_id FROM gold) AND score >= 0.2
    UNION SELECT 'hybrid_logistic', t.org_id, t.code FROM tags t LEFT JOIN ranks r ON r.org_id = t.org_id AND r.code = t.code
    WHERE t.org_id IN (SELECT org_id FROM gold) AND coalesce(r.score, 0) >= 0.12)),
""" + metrics_sql("members", "facts", "guess", "approach")


@query("compare_approaches", _COMPARE + f"\nSELECT approach, rows, {METRIC_SQL}, round({OBJECTIVE_SQL}, 6) AS weighted_primary FROM measured")
def compare_approaches(spark, sf):
    by_rules = eval_rows(spark, sf)
    s = score_lists(spark, sf)
    sets = by_rules.select("org_id", "true_codes", F.col("predicted_codes").alias("rule_codes"))
    model = sets.join(s, "org_id").withColumn("predicted_codes", decide.decided(F.col("ranked"), 0.2))
    both = decide.combined(F.col("predicted_codes"), F.col("rule_codes"), F.col("ranked"), "label_conf_gated_regex", label_conf=0.12)
    evals = {
        "regex": by_rules,
        "ovr_logistic": model,
        "hybrid_logistic": model.withColumn("predicted_codes", both),
    }
    return rows6(workflow.compare_evals(evals), *METRIC_COLS, "weighted_primary")


@query("eval_rules_full", with_ctes("", ("gold", "truth", "pred")).rstrip() + ",\n" + metrics_sql("gold", "truth", "pred")
       + f"\nSELECT 'regex' AS approach, rows, {METRIC_SQL}, round({OBJECTIVE_SQL}, 6) AS weighted_primary FROM measured")
def eval_rules_full(spark, sf):
    return rows6(workflow.eval_rules_full(gold(spark, sf), RULES), *METRIC_COLS, "weighted_primary")



"""Queries that fit models: SQL checks their labels, optimality, features and what fixed coefficients yield."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.base import (
    GROUPED, METRIC_COLS, METRIC_SQL, OBJECTIVE_SQL, RULES, cte, gold, metrics_sql, query, records, rows6, scratch, stacked, taxonomy, values, with_ctes,
)
from tagspark import fixed
from tagspark.operators import boosting, joins, metrics, models, ranking
from tagspark.operators.linear import arrow_vectors
from tagspark.plans import grid, jobs, workflow

cte("gt", "SELECT DISTINCT org_id, unnest(regexp_extract_all(lower(corpus), '[\\p{L}\\p{N}_]{2,}')) AS term FROM gold", ("gold",))

LOGISTIC = models.Settings(clean_text=False, model_c=10.0, threshold=0.3, fallback_mode="top_k", top_k_fallback=1)
HYBRID = models.Settings(
    approach="hybrid_logistic", clean_text=False, model_c=10.0, threshold=0.3, hybrid_rule="label_conf_gated_regex", hybrid_conf=0.05
)
SVC = models.Settings(approach="ovr_svc", clean_text=False, model_family="linear_svc", model_c=1.0, threshold=-0.25)
SGD = models.Settings(
    approach="ovr_sgd", clean_text=False, model_family="sgd", sgd_loss="modified_huber", sgd_alpha=0.0005, threshold=0.3
)
LOG_SGD = models.Settings(
    approach="ovr_sgd", clean_text=False, model_family="sgd", sgd_loss="log_loss", sgd_alpha=0.0005, threshold=0.3
)


#: The one word that the records of the followed fits are read for; a vector is then 1 or nothing.
WORD = "the"
LABELS = ["DE201", "EN101", "ES101", "FR101", "TX201"]


def one_word(df):
    """Records whose text is the one word, if they hold it, or nothing."""
    holds = F.array_contains(models.word_tokens(F.col("corpus")), WORD)
    return df.withColumn("corpus", F.when(holds, WORD).otherwise(""))


cte("holds", f"SELECT org_id, max((term = '{WORD}')::INT) AS x FROM token_rows GROUP BY org_id", ("token_rows",))


def fit_sql(loss: str, l2: str, weights: str, on_bias: bool, rows: str) -> str:
    """Expressions that minimise a label's objective over one feature of 0 or 1 and a bias, by Newton steps on the four counts of label
    and feature: ``rows`` has org_id, x; ``truth`` the labels. Gives ``fitted`` (code, w, b)."""
    def slopes(m: str, sign: int) -> tuple[str, str]:
        """First and second derivative of the loss at margin ``m`` of a row of label ``sign``."""
        z = f"({sign} * ({m}))"
        if loss == "logistic":
            p = f"(1 / (1 + exp(-({m}))))"
            return f"({p} - {1 if sign > 0 else 0})", f"({p} * (1 - {p}))"
        hinge = f"{-2 * sign} * greatest(0, 1 - {z})", f"CASE WHEN {z} < 1 THEN 2 ELSE 0 END"
        if loss == "squared_hinge":
            return f"({hinge[0]})", f"({hinge[1]})"
        return f"(CASE WHEN {z} < -1 THEN {-4 * sign} ELSE {hinge[0]} END)", f"(CASE WHEN {z} < -1 THEN 0 ELSE {hinge[1]} END)"

    up, down = ("1.0", "1.0") if weights == "none" else ("n / (2.0 * pos)", "n / (2.0 * (n - pos))")
    cells = [("n11", up, "w + b", 1), ("n10", down, "w + b", -1), ("n01", up, "b", 1), ("n00", down, "b", -1)]
    one = [[f"{c} * {u} * {slopes(m, y)[i]}" for c, u, m, y in cells] for i in (0, 1)]
    both = [" + ".join(x) for x in one]
    of_word = [" + ".join(x[:2]) for x in one]
    bias = "l2" if on_bias else "0"
    return f"""counted AS (SELECT c.code, {l2} AS l2, count(*) AS n, sum((t.code IS NOT NULL)::INT) AS pos, sum(((t.code IS NOT NULL) AND x = 1)::INT) AS n11,
    sum(((t.code IS NULL) AND x = 1)::INT) AS n10, sum(((t.code IS NOT NULL) AND x = 0)::INT) AS n01, sum(((t.code IS NULL) AND x = 0)::INT) AS n00
    FROM {rows} r CROSS JOIN (SELECT DISTINCT code FROM truth) c LEFT JOIN truth t ON t.org_id = r.org_id AND t.code = c.code GROUP BY c.code),
  steps AS (SELECT *, 0 AS k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM counted
    UNION ALL SELECT code, l2, n, pos, n11, n10, n01, n00, k + 1, w - near * dw, b - near * db FROM
      (SELECT *, least(1, 1 / (abs(dw) + abs(db) + 1e-300)) AS near FROM
        (SELECT *, (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb) AS dw, (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb) AS db FROM
          (SELECT *, ({of_word[0]}) / n + l2 * w AS gw, ({both[0]}) / n + {bias} * b AS gb, ({of_word[1]}) / n + l2 + 1e-12 AS hww,
            ({of_word[1]}) / n AS hwb, ({both[1]}) / n + {bias} + 1e-12 AS hbb FROM steps WHERE k < 60))),
  ),
  fitted AS (SELECT code, w, b FROM steps WHERE k = 60)"""


def follow(loss: str, l2: str, weights: str = "none", on_bias: bool = False) -> str:
    base = with_ctes("", ("truth", "gold", "holds")).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return base + """,
  seen AS (SELECT g.org_id, coalesce(h.x, 0) AS x FROM gold g LEFT JOIN holds h ON h.org_id = g.org_id),
""" + fit_sql(loss, l2, weights, on_bias, "seen") + "\nSELECT code AS label, round(w, 4) AS coef, round(b, 4) AS intercept FROM fitted"


def _fit_values(spark, sf, s, fit):
    """Coefficient and intercept of each label, fitted on the labelled records read for one word."""
    _, kept = models.prepared(one_word(gold(spark, sf)), s)
    labels, coef, intercept, _ = fit(kept)
    rows = [(c, float(w[0]), float(b)) for c, w, b in zip(labels, coef, intercept, strict=True)]
    out = spark.createDataFrame(rows, "label string, coef double, intercept double")
    return out.select("label", F.round("coef", 4).alias("coef"), F.round("intercept", 4).alias("intercept"))


CLOSE = 1e-9


@query("fit_ovr_logistic", follow("logistic", "1.0 / (10.0 * count(*))"))
def fit_ovr_logistic(spark, sf):
    return _fit_values(spark, sf, LOGISTIC, lambda f: models.fit_ovr_logistic(f, 10.0, tol=CLOSE))


@query("fit_ovr_logistic_balanced", follow("logistic", "1.0 / (10.0 * count(*))", "balanced"))
def fit_ovr_logistic_balanced(spark, sf):
    return _fit_values(spark, sf, LOGISTIC, lambda f: models.fit_ovr_logistic(f, 10.0, "balanced", tol=CLOSE))


@query("fit_ovr_svc", follow("squared_hinge", "1.0 / (1.0 * count(*))", on_bias=True))
def fit_ovr_svc(spark, sf):
    return _fit_values(spark, sf, SVC, lambda f: models.fit_ovr_svc(f, 1.0, tol=CLOSE))


@query("fit_ovr_sgd", follow("modified_huber", "0.0005"))
def fit_ovr_sgd(spark, sf):
    return _fit_values(spark, sf, SGD, lambda f: models.fit_ovr_sgd(f, "modified_huber", SGD.sgd_alpha, tol=CLOSE))


@query("fit_ovr_sgd_log_loss", follow("logistic", "0.0005"))
def fit_ovr_sgd_log_loss(spark, sf):
    return _fit_values(spark, sf, LOG_SGD, lambda f: models.fit_ovr_sgd(f, "log_loss", LOG_SGD.sgd_alpha, tol=CLOSE))


@query("fit_ovr_all_words")
def fit_ovr_all_words(spark, sf):
    """A fit on all words of the labelled records: steps that each label took."""
    model = models.train_final(gold(spark, sf), LOGISTIC)
    return spark.createDataFrame([(c, x["steps"], x["converged"]) for c, x in sorted(model.info["steps"].items())], "label string, steps int, converged boolean")


def _part_squares(vectors, n_words):
    """Squared length of the first ``n_words`` places and of the others, from the values that the sparse rows ``org_id, features`` hold."""
    def run(batches):
        for batch in batches:
            index, value, offsets = arrow_vectors(batch.column(1))
            row, square = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), value * value
            sums = [np.bincount(row, square * at, minlength=batch.num_rows).astype(np.float64) for at in (index < n_words, index >= n_words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["org_id", "words", "characters"])

    return vectors.select("org_id", "features").mapInArrow(run, "org_id string, words double, characters double")


@query("feature_union", """SELECT g.org_id, CASE WHEN w.org_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS words, 1.0::DOUBLE AS characters FROM gold g LEFT JOIN
  (SELECT DISTINCT org_id FROM gt JOIN (SELECT term FROM gt GROUP BY term HAVING count(*) >= 2) USING (term)) w ON g.org_id = w.org_id""", ("gt", "gold"))
def feature_union(spark, sf):
    """Squared length of the word part and of the character part of each record's vector."""
    s = models.Settings(clean_text=False, char_ngram_max=4)
    tokens = models._tokenised(gold(spark, sf).withColumn("_text", F.col("corpus")), "_text", s)
    # counting, weighting and the vectors all read the tokens
    tokens = models.keep_for_fits(tokens.select("org_id", "_words", "_chars"))
    pipeline = models.feature_union(tokens, s)
    out = _part_squares(pipeline.transform(tokens), pipeline.stages[0].size)
    return out.select("org_id", F.round("words", 6).alias("words"), F.round("characters", 6).alias("characters"))


def _slopes(scored, classes):
    """(term, class_code, slope) of the multinomial loss, summed by batch over the values that the sparse rows ``features, p, class_code`` hold."""
    def run(batches):
        for batch in batches:
            index, value, offsets = arrow_vectors(batch.column(0))
            d = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            d = d - (np.array(batch.column(2).to_pylist(), object)[:, None] == np.array(classes, object))
            terms, at = np.unique(index, return_inverse=True)
            sums = np.zeros((len(terms), len(classes)))
            np.add.at(sums, at, value[:, None] * d[np.repeat(np.arange(batch.num_rows), np.diff(offsets))])
            cells = [pa.array(np.repeat(terms.astype(np.int32), len(classes))), pa.array(list(classes) * len(terms), pa.string()), pa.array(sums.ravel())]
            yield pa.RecordBatch.from_arrays(cells, ["term", "class_code", "slope"])

    return scored.select("features", "p", "class_code").mapInArrow(run, "term int, class_code string, slope double")


def _coefficient_rows(spark, classes, matrix):
    """(class_code, term, coef) of all coefficients, made in tasks: the driver only sends the matrix."""
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            for name, row in zip(classes, shared.value, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(at), np.int32))), pa.array(at.astype(np.int32)), pa.array(row[at])], ["class_code", "term", "coef"])

    return spark.range(matrix.shape[1]).mapInArrow(run, "class_code string, term int, coef double")


@query("fit_class_lr", "SELECT DISTINCT class_code, true AS optimal FROM gold", ("gold",))
def fit_class_lr(spark, sf):
    """For each class whether the slope of the multinomial objective vanishes, in long form."""
    g = gold(spark, sf)
    model = models.fit_class_lr(g)
    fitted = model.model.stages[0]
    text = F.col("corpus") if not model.clean else models.clean_text(F.col("corpus"))
    rows = models.featurise(g.withColumn("_text", text), "_text", models._CLASS_FEATURES, model.features, ["org_id", "class_code"])
    scored = fitted.transform(rows).select("features", vector_to_array("probability").alias("p"), "class_code")
    scored = models.keep_for_fits(scored)
    n = scored.count()
    slope = _slopes(scored, model.classes).groupBy("term", "class_code").agg((F.sum("slope") / n).alias("s"))
    coefs = _coefficient_rows(spark, model.classes, fitted.coefficientMatrix.toArray())
    l2 = 1.0 / (fixed.CLASS_C * n)
    worst = coefs.join(slope, ["class_code", "term"], "left").groupBy("class_code").agg(F.max(F.abs(F.coalesce("s", F.lit(0.0)) + l2 * F.col("coef"))).alias("w"))
    return worst.select("class_code", (F.col("w") <= 2e-3).alias("optimal"))


@query("train_final", with_ctes("", ("truth", "gold", "holds", "records")).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
  seen AS (SELECT g.org_id, coalesce(h.x, 0) AS x FROM gold g LEFT JOIN holds h ON h.org_id = g.org_id),
""" + fit_sql("logistic", "1.0 / (10.0 * count(*))", "none", False, "seen") + """
SELECT r.org_id, f.code, round(1 / (1 + exp(-(f.b + f.w * coalesce(h.x, 0)))), 3) AS score FROM records r CROSS JOIN fitted f LEFT JOIN holds h ON h.org_id = r.org_id""")
def train_final(spark, sf):
    """Scores of all records by a model trained on the labelled ones, all read for one word."""
    model = models.train_final(one_word(gold(spark, sf)), HYBRID, tol=CLOSE)
    scored = model.scores(one_word(records_corpus(spark, sf)))
    return scored.select("org_id", "code", F.round("score", 3).alias("score"))


def fixed_model(spark, sf, s):
    """The fixed coefficients as a stored model, over features fitted on all records: SQL can follow its scores."""
    from checks.base import COEFS, INTERCEPTS

    tokens = models._tokenised(records_corpus(spark, sf).withColumn("_text", F.col("corpus")), "_text", s)
    pipeline = models.feature_union(tokens, s)
    place = models.word_places(pipeline, [term for term, _, _ in COEFS], spark)
    labels = sorted(INTERCEPTS)
    coef = np.zeros((len(labels), pipeline.size))
    for term, code, w in COEFS:
        if term in place:
            coef[labels.index(code), place[term]] = w
    path = scratch(spark) + "/fixed"
    models.OvrModel(s, pipeline, labels, coef, np.array([INTERCEPTS[c] for c in labels]), "sigmoid").save(spark, path)
    return models.OvrModel.load(spark, path)


def records_corpus(spark, sf):
    from checks.base import corpus

    return corpus(spark, sf)


@query("model_io", with_ctes("", ("truth", "gold", "holds")).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
  seen AS (SELECT g.org_id, coalesce(h.x, 0) AS x FROM gold g LEFT JOIN holds h ON h.org_id = g.org_id),
""" + fit_sql("squared_hinge", "1.0 / (1.0 * count(*))", "none", True, "seen") + """
SELECT s.org_id, f.code, round(f.b + f.w * s.x, 3) AS score FROM seen s CROSS JOIN fitted f""")
def model_io(spark, sf):
    """Scores of a fitted model that was saved and loaded again."""
    g = one_word(gold(spark, sf))
    path = scratch(spark) + "/model"
    models.train_final(g, SVC, tol=CLOSE).save(spark, path)
    return models.OvrModel.load(spark, path).scores(g).select("org_id", "code", F.round("score", 3).alias("score"))


@query("model_compare")
def model_compare(spark, sf):
    """Eight learners on one split: measures of the whole, and the report of every class."""
    dev, test = ranking.split_holdout(gold(spark, sf), "org_id", 0.3, 42)
    names = ["naive_bayes", "logistic_regression", "linear_svc", "sgd_hinge", "decision_tree", "random_forest", "kernel_svc", "ada_boost"]
    rows = models.model_compare(models.keep_for_fits(dev), models.keep_for_fits(test), names, rounds=8)
    return metrics.multiclass_metrics(rows, "truth", "class_code", by=("classifier",), report=True)


@query("boosted_stump", with_ctes("", ("gold", "gt")).rstrip() + """,
  side AS (SELECT t.term, c.class_code, count(g.org_id) AS n FROM (SELECT DISTINCT term FROM gt) t CROSS JOIN (SELECT DISTINCT class_code FROM gold) c
    LEFT JOIN (SELECT gt.term, gold.class_code, gold.org_id FROM gt JOIN gold ON gt.org_id = gold.org_id) g ON g.term = t.term AND g.class_code = c.class_code GROUP BY ALL),
  whole AS (SELECT class_code, count(*) AS total, (SELECT count(*) FROM gold) AS rows FROM gold GROUP BY class_code),
  both_sides AS (SELECT s.term, s.class_code, s.n / w.rows::DOUBLE AS yes, (w.total - s.n) / w.rows::DOUBLE AS no FROM side s JOIN whole w ON w.class_code = s.class_code),
  gains AS (SELECT term, round(sum(yes * yes) / sum(yes) + CASE WHEN sum(no) > 1e-12 THEN sum(no * no) / sum(no) ELSE 0 END, 9) AS gain FROM both_sides GROUP BY term),
  best AS (SELECT term FROM gains ORDER BY gain DESC, term LIMIT 1),
  named AS (SELECT b.term, (SELECT class_code FROM both_sides x WHERE x.term = b.term ORDER BY round(yes, 9) DESC, class_code LIMIT 1) AS present,
    (SELECT class_code FROM both_sides x WHERE x.term = b.term ORDER BY round(no, 9) DESC, class_code LIMIT 1) AS absent FROM best b)
SELECT g.org_id, n.term, CASE WHEN h.org_id IS NULL THEN n.absent ELSE n.present END AS class_code FROM gold g CROSS JOIN named n
  LEFT JOIN gt h ON h.org_id = g.org_id AND h.term = n.term""")
def boosted_stump(spark, sf):
    """The first round of boosting on all words, and what its stump says of each record."""
    g = gold(spark, sf)
    model = boosting.fit_boosted(g, rounds=1, clean=False)
    return model.predict(g).select("org_id", F.lit(model.stumps[0].term).alias("term"), "class_code")


@query("two_step_holdout")
def two_step_holdout(spark, sf):
    """Both steps fitted on one part of the labelled rows and judged on the other."""
    dev, test = ranking.split_holdout(gold(spark, sf), "org_id", 0.3, 42)
    out = models.two_step_classify(models.keep_for_fits(dev), models.keep_for_fits(test))
    return metrics.multiclass_metrics(out, "truth", "class_code")


# section or class, term, coefficient; the section C has one code only
STEP_COEFS = [
    ("A", "the", 3.0), ("A", "and", 1.0), ("A", "pour", 3.5), ("A", "les", 2.0), ("B", "und", 4.0), ("B", "die", 2.0), ("B", "der", 1.5), ("B", "con", 0.5),
    ("C", "para", 4.0), ("C", "por", 2.0), ("C", "con", 3.0), ("C", "que", 0.5),
    ("A10", "the", 3.0), ("A10", "that", 1.25), ("A10", "and", 2.0), ("A20", "pour", 4.0), ("A20", "les", 2.5), ("A20", "que", 1.0), ("A20", "the", 0.25),
    ("B10", "und", 4.0), ("B10", "die", 2.0), ("B20", "der", 3.0), ("B20", "in", 0.75), ("B20", "con", 1.0),
]
STEP_STARTS = {"A": 0.1, "B": -0.05, "C": -0.1, "A10": -0.2, "A20": -0.21, "B10": 0.05, "B20": 0.0}


def stored_scorer(spark, sf, s, coefs, starts, link, path, pipeline=None):
    """Fixed coefficients as a stored model over features fitted on all records, or on them before."""
    if pipeline is None:
        tokens = models._tokenised(records_corpus(spark, sf).withColumn("_text", F.col("corpus")), "_text", s)
        pipeline = models.feature_union(tokens, s)
    place = models.word_places(pipeline, [term for _, term, _ in coefs], spark)
    labels = sorted(starts)
    coef = np.zeros((len(labels), pipeline.size))
    for code, term, w in coefs:
        if term in place and code in starts:
            coef[labels.index(code), place[term]] = w
    model = models.OvrModel(s, pipeline, labels, coef, np.array([starts[c] for c in labels]), link)
    if path:
        model.save(spark, path)
    return models.OvrModel.load(spark, path) if path else model


cte("step_coefs", values(STEP_COEFS, "code", "term", "coef"))
cte("step_starts", values(STEP_STARTS.items(), "code", "b"))
cte("step_scores", """SELECT r.org_id, i.code, any_value(i.b) + coalesce(sum(w.weight * c.coef), 0) AS m
  FROM records r CROSS JOIN step_starts i LEFT JOIN step_coefs c ON c.code = i.code LEFT JOIN weights w ON w.term = c.term AND w.org_id = r.org_id
  GROUP BY r.org_id, i.code""", ("records", "step_starts", "step_coefs", "weights"))
cte("step_sections", """SELECT org_id, code AS section FROM step_scores WHERE length(code) = 1
  QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY m DESC, code) = 1""", ("step_scores",))


@query("two_step_classify", """SELECT s.org_id, s.section, CASE WHEN s.section = 'C' THEN 'C30' ELSE t.code END AS class_code FROM step_sections s
  LEFT JOIN (SELECT * FROM step_scores WHERE length(code) = 3) t ON t.org_id = s.org_id AND substr(t.code, 1, 1) = s.section
  QUALIFY row_number() OVER (PARTITION BY s.org_id ORDER BY t.m DESC, t.code) = 1""", ("step_sections", "step_scores"))
def two_step_classify(spark, sf):
    """A stored model of both steps, read back and applied to all records."""
    s = models.Settings(clean_text=False, min_df=3)
    scorer = lambda codes, alike=None: stored_scorer(spark, sf, s, STEP_COEFS, {c: STEP_STARTS[c] for c in codes}, "margin", None, alike)
    first = scorer("ABC")
    made = models.TwoStepModel(first, {"A": scorer(["A10", "A20"], first.features), "B": scorer(["B10", "B20"], first.features)}, {"C": "C30"})
    path = scratch(spark) + "/two-step"
    made.save(spark, path)
    return models.TwoStepModel.load(spark, path).predict(records_corpus(spark, sf))


@query("eval_class_holdout")
def eval_class_holdout(spark, sf):
    return workflow.eval_class_holdout(gold(spark, sf))


def one_word_gold(spark, sf):
    """Labelled records of which a workflow reads the one word, or nothing."""
    g = one_word(gold(spark, sf))
    return g.select("org_id", F.lit(None).cast("string").alias("name"), F.col("corpus").alias("activities"), F.lit(None).cast("string").alias("objects"), "tags", "class_code")


def held_sql(seed: int, share: float) -> str:
    """Records dealt to ``dev`` and ``held``, the fit on dev and the scores of held records."""
    base = with_ctes("", ("truth", "gold", "holds")).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return base + f""",
  dealt AS (SELECT g.org_id, coalesce(h.x, 0) AS x, row_number() OVER (ORDER BY md5('{seed}:' || g.org_id)) <= ceil(round(count(*) OVER () * {share}, 9)) AS test
    FROM gold g LEFT JOIN holds h ON h.org_id = g.org_id),
  dev AS (SELECT org_id, x FROM dealt WHERE NOT test), held AS (SELECT org_id, x FROM dealt WHERE test),
  held_truth AS (SELECT t.* FROM truth t JOIN held h ON h.org_id = t.org_id),
""" + fit_sql("logistic", "1.0 / (10.0 * count(*))", "none", False, "dev") + """,
  held_scores AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC, code) AS rn, max(score) OVER (PARTITION BY org_id) AS best FROM
    (SELECT h.org_id, h.x, f.code, 1 / (1 + exp(-(f.b + f.w * h.x))) AS score FROM held h CROSS JOIN fitted f)),
  held_pred AS (SELECT org_id, code FROM held_scores WHERE score >= 0.3 OR (best < 0.3 AND rn <= 1))"""


@query("eval_ovr_holdout", held_sql(fixed.EVALUATION_SEED, fixed.TEST_SHARE) + "," + metrics_sql("held", "held_truth", "held_pred") + f"""
SELECT rows, {METRIC_SQL} FROM measured""")
def eval_ovr_holdout(spark, sf):
    out = workflow.eval_ovr_holdout(one_word_gold(spark, sf), LOGISTIC)
    return rows6(metrics.multilabel_metrics(out), *METRIC_COLS)


@query("eval_ovr_all_words")
def eval_ovr_all_words(spark, sf):
    return metrics.multilabel_metrics(workflow.eval_ovr_holdout(gold(spark, sf), LOGISTIC))


@query("final_holdout", held_sql(2026, 0.3) + """,
  held_rules AS (SELECT org_id, 'EN101' AS code FROM held WHERE x = 1),
  held_open AS (SELECT org_id, code FROM held_scores WHERE score >= 0.3),
  held_hybrid AS (SELECT * FROM held_open UNION SELECT r.org_id, r.code FROM held_rules r JOIN held_scores s ON s.org_id = r.org_id AND s.code = r.code WHERE s.score >= 0.05),
  many AS (SELECT a.approach, h.org_id FROM held h CROSS JOIN (VALUES ('regex'), ('ovr_logistic'), ('hybrid_logistic')) a(approach)),
  many_truth AS (SELECT m.approach, t.* FROM held_truth t JOIN many m ON m.org_id = t.org_id),
  many_pred AS (SELECT 'regex' AS approach, * FROM held_rules UNION ALL SELECT 'ovr_logistic', * FROM held_pred UNION ALL SELECT 'hybrid_logistic', * FROM held_hybrid),"""
  + metrics_sql("many", "many_truth", "many_pred", "approach") + f"""
SELECT approach, rows, {METRIC_SQL}, round({OBJECTIVE_SQL}, 6) AS weighted_primary FROM measured""")
def final_holdout(spark, sf):
    dev, test = ranking.split_holdout(one_word_gold(spark, sf), "org_id", 0.3, 2026)
    out = workflow.final_holdout(dev, test, RULES, {"ovr_logistic": LOGISTIC, "hybrid_logistic": HYBRID})
    return rows6(out, *METRIC_COLS, "weighted_primary")


@query("final_all_words")
def final_all_words(spark, sf):
    dev, test = ranking.split_holdout(gold(spark, sf), "org_id", 0.3, 2026)
    return workflow.final_holdout(dev, test, RULES, {"ovr_logistic": LOGISTIC, "hybrid_logistic": HYBRID})


@query("full_workflow")
def full_workflow(spark, sf):
    dev, test = ranking.split_holdout(gold(spark, sf), "org_id", 0.3, 2026)
    values = {
        "clean_text": [False], "model_family": ["logistic"], "threshold": [0.2, 0.4], "ngram_max": [1], "char_ngram_max": [0],
        "model_c": [10.0], "class_weight_mode": ["balanced"], "fallback_mode": ["top_k"], "top_k_fallback": [0, 1], "fallback_min_score": [0.1],
    }
    params = grid.param_grid(spark, "ovr_logistic", values).unionByName(
        grid.param_grid(spark, "hybrid_logistic", {**values, "hybrid_label_confidence_threshold": [0.05, 0.2]})
    )
    _, table = workflow.full_workflow(dev, test, RULES, params, seeds=[42], specs=[("f1_micro", ">=", 0.1)])
    return table


_FIXED = models.Settings(clean_text=False, min_df=3, threshold=0.2, fallback_mode="top_k", top_k_fallback=1)
_NAMED = "SELECT w.org_id, w.code, r.name, x.tag AS code_name FROM {0} w LEFT JOIN records r ON w.org_id = r.org_id LEFT JOIN taxonomy x ON w.code = x.code"


@query("job_tag_ovr", with_ctes("", ("ranks", "manual_long", "records", "taxonomy")).rstrip() + f""",
picked AS (SELECT org_id, code FROM ranks WHERE score >= 0.2 OR (best < 0.2 AND rn <= 1)),
chosen AS (SELECT org_id, code FROM picked WHERE org_id NOT IN (SELECT org_id FROM manual_long) UNION SELECT org_id, code FROM manual_long),
wide AS ({GROUPED.format('chosen')})
{_NAMED.format('wide')}""")
def job_tag_ovr(spark, sf):
    manual = joins.first_label(stacked(spark, sf), "tags")
    out = jobs.job_tag_ovr(records(spark, sf), fixed_model(spark, sf, _FIXED), manual, include_groups=True, taxonomy=taxonomy(spark))
    return out.select("org_id", "code", "name", "code_name")


@query("job_tag_hybrid", with_ctes("", ("ranks", "tags", "manual_long", "records", "taxonomy")).rstrip() + f""",
picked AS (SELECT org_id, code FROM ranks WHERE score >= 0.2 OR (best < 0.2 AND rn <= 1)
  UNION SELECT t.org_id, t.code FROM tags t LEFT JOIN ranks s ON s.org_id = t.org_id AND s.code = t.code WHERE coalesce(s.score, 0) >= 0.12),
chosen AS (SELECT org_id, code FROM picked WHERE org_id NOT IN (SELECT org_id FROM manual_long) UNION SELECT org_id, code FROM manual_long)
{_NAMED.format('chosen')}""")
def job_tag_hybrid(spark, sf):
    s = replace(_FIXED, approach="hybrid_logistic", hybrid_rule="label_conf_gated_regex", hybrid_conf=0.12)
    manual = joins.first_label(stacked(spark, sf), "tags")
    out = jobs.job_tag_hybrid(records(spark, sf), RULES, fixed_model(spark, sf, s), manual, taxonomy(spark))
    return out.select("org_id", "code", "name", "code_name")


@query("job_classify")
def job_classify(spark, sf):
    model = models.fit_class_lr(gold(spark, sf))
    manual = joins.first_label(stacked(spark, sf), "class_code")
    titles = spark.createDataFrame(
        [("A", "A10", None, "English"), ("A", "A20", None, "French"), ("B", "B10", None, "German"), ("B", "B20", None, "Spanish")],
        "section string, group string, sub_group string, title string",
    )
    return jobs.job_classify(records(spark, sf), model, manual, titles)

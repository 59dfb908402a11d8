"""Aggregations, reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    METRIC_COLS,
    METRIC_SQL,
    OBJECTIVE_SQL,
    class_scores,
    corpus,
    eval_rows,
    gold,
    group_tags,
    metrics_sql,
    query,
    records,
    rows6,
    table,
    tags,
    taxonomy,
    truth_sets,
    with_ctes,
)
from checks.q_functions import _band_sql
from tagspark import fixed
from tagspark.functions.codes import band
from tagspark.operators import aggregates as ag
from tagspark.operators import joins, metrics, ranking, rules

FLAGS = ["A", "N", "R"]


@query("collect_codes", "SELECT org_id, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM group_tags GROUP BY org_id", ("group_tags",))
def collect_codes(spark, sf):
    return ag.collect_codes(group_tags(spark, sf)).withColumn("codes", F.array_join("codes", ";"))


@query("distribution", """SELECT coalesce(source, 'Total') AS source, count(*) AS all_n, count(m.org_id) AS category_n,
  round(count(m.org_id) * 1.0 / count(*), 6) AS percentage
  FROM records r LEFT JOIN (SELECT DISTINCT org_id FROM tags WHERE code = 'EN101') m ON r.org_id = m.org_id GROUP BY ROLLUP (source)""", ("records", "tags"))
def distribution(spark, sf):
    members = tags(spark, sf).where(F.col("code") == "EN101")
    return rows6(ag.distribution(records(spark, sf), "source", members), "percentage")


_BAND = _band_sql("income", fixed.INCOME_EDGES, fixed.INCOME_LABELS)

def _category_sql() -> str:
    head = with_ctes("", ("records", "group_tags", "taxonomy")).rstrip()
    return head + f""",
cells AS (SELECT org_id, 'income_band' AS field, {_BAND} AS value FROM records WHERE {_BAND} IS NOT NULL
  UNION ALL SELECT org_id, 'source', source FROM records WHERE source IS NOT NULL),
members AS (SELECT DISTINCT x.code, t.org_id FROM group_tags t JOIN taxonomy x ON starts_with(t.code, x.code)),
counted AS (SELECT m.code, c.field, c.value, count(*) AS k FROM members m JOIN cells c ON m.org_id = c.org_id GROUP BY ALL),
totals AS (SELECT field, value, count(*) AS n FROM cells GROUP BY ALL),
frame AS (SELECT x.code, t.field, t.value, t.n, coalesce(c.k, 0) AS k FROM taxonomy x CROSS JOIN totals t
  LEFT JOIN counted c ON c.code = x.code AND c.field = t.field AND c.value = t.value)
SELECT code, field, value, n AS all_n, k AS category_n, round(k * 1.0 / n, 6) AS percentage FROM frame
UNION ALL SELECT code, field, 'Total', sum(n)::BIGINT, sum(k)::BIGINT, round(sum(k) * 1.0 / sum(n), 6) FROM frame GROUP BY code, field"""


@query("category_report", _category_sql())
def category_report(spark, sf):
    r = records(spark, sf).withColumn("income_band", band(F.col("income"), fixed.INCOME_EDGES, fixed.INCOME_LABELS))
    out = ag.category_report(r, group_tags(spark, sf), taxonomy(spark), ["income_band", "source"])
    return rows6(out, "percentage")


@query("crosstab", """SELECT l_shipdate::DATE AS day, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N",
  count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def crosstab(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return ag.crosstab(li, "day", "l_returnflag", FLAGS)


def _share_sql(whole: str) -> str:
    cols = ", ".join(f"""coalesce(max(CASE WHEN l_returnflag = '{v}' THEN p END), 0.0) AS "{v}" """ for v in FLAGS)
    return f"""SELECT l_linenumber, {cols} FROM (SELECT l_linenumber, l_returnflag,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY {whole}), 1) AS p FROM lineitem GROUP BY l_linenumber, l_returnflag) GROUP BY 1"""


@query("crosstab_share", _share_sql("l_linenumber"))
def crosstab_share(spark, sf):
    return ag.crosstab_share(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", FLAGS)


@query("crosstab_share_columns", _share_sql("l_returnflag"))
def crosstab_share_columns(spark, sf):
    return ag.crosstab_share(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", FLAGS, by="column")


@query("crosstab_margins", """SELECT x.tag, count(*) FILTER (d) AS direct, count(*) FILTER (NOT d) AS indirect, count(*) AS total,
  round(count(*) FILTER (d) * 100.0 / (SELECT count(*) FROM records), 1) AS direct_percent,
  round(count(*) FILTER (NOT d) * 100.0 / (SELECT count(*) FROM records), 1) AS indirect_percent,
  round(count(*) * 100.0 / (SELECT count(*) FROM records), 1) AS total_percent
  FROM (SELECT org_id, substr(code, 1, 2) AS code, max(length(code) = 2) AS d FROM tags GROUP BY 1, 2) t
  JOIN taxonomy x ON t.code = x.code GROUP BY x.tag""", ("records", "tags", "taxonomy"))
def crosstab_margins(spark, sf):
    n = records(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    return ag.crosstab_margins(tags(spark, sf), taxonomy(spark), n)


@query("value_share", """SELECT event_type, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def value_share(spark, sf):
    return rows6(ag.value_share(table(spark, sf, "events"), "event_type", normalise=True), "share")


@query("group_size", f"""SELECT band, source, count(*) AS n FROM (SELECT {_BAND} AS band, source FROM records) WHERE band IS NOT NULL GROUP BY ALL""", ("records",))
def group_size(spark, sf):
    r = records(spark, sf).withColumn("band", band(F.col("income"), fixed.INCOME_EDGES, fixed.INCOME_LABELS))
    return ag.group_size(r, ["band", "source"])


@query("tags_per_record", """SELECT CASE WHEN n >= 3 THEN '3 or over' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM
  (SELECT r.org_id, count(t.code) AS n FROM records r LEFT JOIN tags t ON r.org_id = t.org_id GROUP BY r.org_id) GROUP BY 1""", ("records", "tags"))
def tags_per_record(spark, sf):
    return ag.tags_per_record(records(spark, sf), tags(spark, sf), cap=3)


_DESCRIBE = """count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, quantile_cont(v, 0.25)::DOUBLE AS q1,
  quantile_cont(v, 0.5)::DOUBLE AS median, quantile_cont(v, 0.75)::DOUBLE AS q3, max(v) AS max, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))::DOUBLE AS iqr"""


@query("describe_by", f"""SELECT n_codes, {_DESCRIBE} FROM (SELECT r.org_id, any_value(length(r.corpus))::INTEGER AS v, count(t.code) AS n_codes
  FROM corpus r LEFT JOIN tags t ON r.org_id = t.org_id GROUP BY r.org_id) GROUP BY n_codes""", ("corpus", "tags"))
def describe_by(spark, sf):
    lengths = corpus(spark, sf).select("org_id", F.length("corpus").alias("v"))
    return rows6(ag.describe_by(joins.count_join(lengths, tags(spark, sf)), "n_codes", "v"), "mean", "std")


@query("hist", """SELECT l_returnflag, CAST(least(floor(l_discount * 100 * 0.99 / 10 * 20) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM
  (SELECT l_returnflag, l_discount FROM lineitem) WHERE l_discount BETWEEN 0 AND 1 GROUP BY ALL""")
def hist(spark, sf):
    # Discounts are hundredths up to 0.1; the factor keeps them off the bin edges.
    li = table(spark, sf, "lineitem").withColumn("x", F.col("l_discount") * 100 * 0.99 / 10)
    return ag.hist(li, "x", "l_returnflag")


@query("bin2d", """SELECT CAST(floor(length(c.corpus) / 500.0) AS BIGINT) AS x_bin, CAST(floor(n / 1.0) AS BIGINT) AS y_bin, count(*) AS n FROM corpus c JOIN
  (SELECT r.org_id, count(t.code) AS n FROM corpus r LEFT JOIN tags t ON r.org_id = t.org_id GROUP BY r.org_id) k ON k.org_id = c.org_id GROUP BY 1, 2""", ("corpus", "tags"))
def bin2d(spark, sf):
    lengths = corpus(spark, sf).select("org_id", F.length("corpus").alias("v"))
    return ag.bin2d(joins.count_join(lengths, tags(spark, sf)), "v", "n_codes", 500.0, 1.0)


@query("actual_vs_predicted", """SELECT coalesce(a.code, p.code) AS code, coalesce(actual, 0) AS actual, coalesce(predicted, 0) AS predicted FROM
  (SELECT class_code AS code, count(*) AS actual FROM gold GROUP BY 1) a FULL JOIN
  (SELECT c.code, count(*) AS predicted FROM class_ranks c JOIN gold g ON g.org_id = c.org_id WHERE rn = 1 GROUP BY 1) p ON a.code = p.code""", ("gold", "class_ranks"))
def actual_vs_predicted(spark, sf):
    return ag.actual_vs_predicted(class_predictions(spark, sf), "class_code", "predicted")


def class_predictions(spark, sf):
    """Labelled records with the best of four fixed class scores."""
    best = ranking.argmax_class(class_scores(spark, sf), out="predicted")
    return gold(spark, sf).select("org_id", "class_code").join(best, "org_id")


@query("taxonomy_levels", """SELECT count(*) FILTER (l_linenumber = 1) AS n_categories, count(*) FILTER (l_linenumber = 2) AS n_subcategories,
  count(*) FILTER (l_linenumber >= 2) AS n_tags FROM lineitem""")
def taxonomy_levels(spark, sf):
    return ag.taxonomy_levels(table(spark, sf, "lineitem"), "l_linenumber")


@query("label_support", """SELECT count(*) AS n_labels, min(n) AS smallest FROM (SELECT class_code, count(*) AS n FROM gold GROUP BY 1)""", ("gold",))
def label_support(spark, sf):
    return ag.label_support(gold(spark, sf), "class_code")


def _metric_sql(uses, members, truth, pred, tail, by="") -> str:
    return with_ctes("", uses).rstrip() + ",\n" + metrics_sql(members, truth, pred, by) + "\n" + tail


_MULTI = _metric_sql(("gold", "truth", "pred"), "gold", "truth", "pred", f"SELECT rows, {METRIC_SQL} FROM measured")


@query("multilabel_metrics", _MULTI)
def multilabel_metrics(spark, sf):
    return rows6(metrics.multilabel_metrics(eval_rows(spark, sf)), *METRIC_COLS)


@query("multilabel_metrics_by", _metric_sql(
    ("gold", "truth", "pred"), "gold", "btruth", "bpred", f"SELECT source, rows, {METRIC_SQL} FROM measured", "source"
).replace("cells AS (", "btruth AS (SELECT g.source, t.* FROM truth t JOIN gold g ON t.org_id = g.org_id), bpred AS (SELECT g.source, t.* FROM pred t JOIN gold g ON t.org_id = g.org_id),\n  cells AS (", 1))
def multilabel_metrics_by(spark, sf):
    from checks.base import RULES

    g = truth_sets(gold(spark, sf))
    sets = rules.tag_sets(g, RULES, out="predicted_codes")
    return rows6(metrics.multilabel_metrics(sets, by=("source",)), *METRIC_COLS)


@query("per_label_prf", """SELECT code, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM
  (SELECT coalesce(t.code, p.code) AS code, count(*) FILTER (t.code IS NOT NULL AND p.code IS NOT NULL) AS tp,
    count(*) FILTER (t.code IS NULL) AS fp, count(*) FILTER (p.code IS NULL) AS fn
    FROM truth t FULL JOIN pred p ON t.org_id = p.org_id AND t.code = p.code GROUP BY 1)""", ("truth", "pred"))
def per_label_prf(spark, sf):
    return rows6(metrics.per_label_prf(eval_rows(spark, sf)), "precision", "recall", "f1")


@query("multiclass_metrics", """SELECT (SELECT count(*) FROM class_pairs) AS rows, (SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) FROM class_pairs) AS accuracy,
  round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro, round(avg(f), 6) AS f1_macro, round(sum(f * nt) / sum(nt), 6) AS f1_weighted FROM
  (SELECT nt, CASE WHEN np = 0 THEN 0.0 ELSE tp * 1.0 / np END AS pr, CASE WHEN nt = 0 THEN 0.0 ELSE tp * 1.0 / nt END AS re, 2.0 * tp / (nt + np) AS f FROM
    (SELECT l.c, (SELECT count(*) FROM class_pairs WHERE y = l.c AND p = l.c) AS tp, (SELECT count(*) FROM class_pairs WHERE y = l.c) AS nt,
      (SELECT count(*) FROM class_pairs WHERE p = l.c) AS np FROM (SELECT y AS c FROM class_pairs UNION SELECT p FROM class_pairs) l))""", ("class_pairs",))
def multiclass_metrics(spark, sf):
    out = metrics.multiclass_metrics(class_predictions(spark, sf), "class_code", "predicted")
    return rows6(out, "accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")


GROUPS = [("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("5+", 5, 85), ("all", 86, 86)]


@query("accuracy_by_group", """SELECT g.name AS "group", count(*) AS rows, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS correct
  FROM lineitem JOIN (VALUES ('1', 1, 1), ('2', 2, 2), ('3-5', 3, 5), ('5+', 5, 85), ('all', 86, 86)) AS g(name, lo, hi)
  ON l_linenumber BETWEEN lo AND hi GROUP BY 1""")
def accuracy_by_group(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("correct", F.col("l_returnflag") == "N")
    return rows6(ag.accuracy_by_group(li, GROUPS, "l_linenumber"), "correct")


@query("grid_mean_std", """SELECT p_brand, p_type, round(avg(p_size), 6) AS p_size_mean, round(avg(p_retailprice), 6) AS p_retailprice_mean,
  round(stddev_samp(p_size), 6) AS p_size_std, round(stddev_samp(p_retailprice), 6) AS p_retailprice_std FROM part GROUP BY ALL""")
def grid_mean_std(spark, sf):
    out = ag.grid_mean_std(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_size", "p_retailprice"])
    return rows6(out, *[c for c in out.columns if c.endswith(("_mean", "_std"))])


@query("weighted_objective", _metric_sql(
    ("gold", "truth", "pred"), "gold", "truth", "pred", f"SELECT rows, round({OBJECTIVE_SQL}, 6) AS weighted_primary FROM measured"))
def weighted_objective(spark, sf):
    out = ag.weighted_objective(metrics.multilabel_metrics(eval_rows(spark, sf)))
    return rows6(out, "weighted_primary").select("rows", "weighted_primary")


@query("guardrails", """SELECT l_orderkey, f1, ham FROM (SELECT l_orderkey, round(avg(l_discount), 6) AS f1, round(avg(l_tax), 6) AS ham FROM lineitem GROUP BY 1)
  WHERE f1 >= 0.05 AND ham < 0.03""")
def guardrails(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg("l_discount"), 6).alias("f1"), F.round(F.avg("l_tax"), 6).alias("ham")
    )
    return ag.guardrails(s, [("f1", ">=", 0.05), ("ham", "<", 0.03)], suffix="")


# --- described in documents ----------------------------------------------------
def _label_terms_sql() -> str:
    from checks.q_functions import clean_sql

    head = with_ctes("", ("gold", "truth")).rstrip()
    return head + f""",
cw AS (SELECT org_id, string_split({clean_sql('corpus')}, ' ') AS w FROM gold),
grams AS (SELECT org_id, unnest(w) AS term FROM cw UNION ALL
  SELECT org_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cw)
SELECT code, term, n FROM (SELECT t.code, g.term, count(*) AS n, row_number() OVER (PARTITION BY t.code ORDER BY count(*) DESC, g.term) AS rn
  FROM grams g JOIN truth t ON g.org_id = t.org_id WHERE g.term <> '' GROUP BY t.code, g.term) WHERE rn <= 20"""


@query("label_terms", _label_terms_sql())
def label_terms(spark, sf):
    return ag.label_terms(truth_sets(gold(spark, sf)), 20)


@query("rule_misses", """SELECT org_id, code, 'false_negative' AS kind FROM truth EXCEPT SELECT org_id, code, 'false_negative' FROM pred
  UNION ALL (SELECT org_id, code, 'false_positive' FROM pred EXCEPT SELECT org_id, code, 'false_positive' FROM truth)""", ("truth", "pred"))
def rule_misses(spark, sf):
    return ag.rule_misses(eval_rows(spark, sf))


_PATTERNS = {"red": r"^red", "rings": r"ring", "widgets": r"widget"}


@query("bulk_exclude", """SELECT excluded_group, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p_name, '^red', 'i') THEN 'red'
  WHEN regexp_matches(p_name, 'ring', 'i') THEN 'rings' WHEN regexp_matches(p_name, 'widget', 'i') THEN 'widgets' ELSE 'rest' END AS excluded_group FROM part) GROUP BY 1""")
def bulk_exclude(spark, sf):
    rest, counts = ranking.bulk_exclude(table(spark, sf, "part"), _PATTERNS, "p_name")
    return counts.unionByName(rest.agg(F.lit("rest").alias("excluded_group"), F.count(F.lit(1)).alias("n")))


@query("coder_agreement", """SELECT coders, agreeing, CASE WHEN agreeing = coders THEN 'all' WHEN agreeing = 1 THEN 'none' ELSE 'some' END AS agreement,
  items, round(items * 1.0 / sum(items) OVER (PARTITION BY coders), 6) AS share FROM (SELECT coders, agreeing, count(*) AS items FROM
  (SELECT conv_id, max(v) AS agreeing, sum(v)::BIGINT AS coders FROM (SELECT conv_id, role, count(*) AS v FROM conversations GROUP BY ALL) GROUP BY 1) GROUP BY ALL)""")
def coder_agreement(spark, sf):
    return rows6(ag.coder_agreement(table(spark, sf, "conversations"), "conv_id", "role"), "share")

"""Rule matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import EDGE_L, EDGE_R, RULES, corpus, eval_rows, gold, query, tags, taxonomy, term_table, with_ctes, words
from tagspark.functions.codes import join_codes
from tagspark.operators import rules
from tagspark.sources.sinks import prediction_rows


@query("tag_by_rules", "SELECT org_id, code FROM tags", ("tags",))
def tag_by_rules(spark, sf):
    return tags(spark, sf)


_EVAL = """SELECT g.org_id, coalesce((SELECT string_agg(code, ';' ORDER BY code) FROM truth t WHERE t.org_id = g.org_id), '') AS true_codes,
  coalesce((SELECT string_agg(code, ';' ORDER BY code) FROM {0} p WHERE p.org_id = g.org_id), '') AS predicted_codes,
  'regex_rules' AS prediction_source FROM gold g"""


@query("tag_by_rules_eval", _EVAL.format("pred"), ("gold", "truth", "pred"))
def tag_by_rules_eval(spark, sf):
    return prediction_rows(eval_rows(spark, sf))


@query("tag_by_rules_eval_groups", _EVAL.format("group_tags"), ("gold", "truth", "group_tags"))
def tag_by_rules_eval_groups(spark, sf):
    return prediction_rows(rules.tag_by_rules_eval(gold(spark, sf), RULES, include_groups=True))


@query("related_codes", """SELECT t.org_id, string_agg(DISTINCT trim(x.c), ';' ORDER BY trim(x.c)) AS candidates FROM tags t
  JOIN (SELECT code, unnest(string_split(related, ';')) AS c FROM taxonomy) x ON t.code = x.code
  WHERE trim(x.c) <> '' GROUP BY t.org_id""", ("tags", "taxonomy"))
def related_codes(spark, sf):
    out = rules.related_codes(tags(spark, sf), taxonomy(spark))
    return out.select("org_id", join_codes(F.col("candidates")).alias("candidates"))



_FREQUENT = "SELECT term FROM dfs WHERE regexp_matches(term, '^[a-z]+$') ORDER BY df DESC, term LIMIT 250"


@query("tag_many_rules", f"""SELECT DISTINCT t.org_id, 'T-' || t.term AS code FROM
  (SELECT org_id, unnest(regexp_extract_all(lower(corpus), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM corpus) t JOIN ({_FREQUENT}) f ON f.term = t.term""", ("corpus", "dfs"))
def tag_many_rules(spark, sf):
    """As many rules as a real list has, one for each of the most frequent words."""
    known = term_table(spark, sf).select("term", "df").distinct().where(F.col("term").rlike("^[a-z]+$"))
    listed = known.orderBy(F.desc("df"), "term").limit(250)
    made = rules.load_rules(listed.select(F.concat(F.lit("T-"), "term").alias("code"), F.format_string(words("%s"), "term").alias("include"), F.lit(None).cast("string").alias("exclude")))
    return rules.tag_by_rules(corpus(spark, sf), made)


_MANY = """SELECT term, row_number() OVER (ORDER BY df DESC, term) AS r FROM dfs WHERE regexp_matches(term, '^[a-z]{3,}$')
  QUALIFY r <= 5000"""


@query("tag_indexed_rules", with_ctes("", ("corpus", "dfs")).rstrip() + f""",
many AS ({_MANY}),
toks AS (SELECT DISTINCT org_id, unnest(regexp_extract_all(lower(corpus), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM corpus),
vocab AS (SELECT DISTINCT w FROM toks),
plain AS (SELECT term, 'W-' || term AS code FROM many WHERE r % 3 = 0),
calls AS (SELECT term AS w, code FROM plain
  UNION ALL SELECT v.w, 'B-' || m.term FROM many m JOIN vocab v ON starts_with(v.w, m.term) WHERE m.r % 3 = 1
  UNION ALL SELECT v.w, 'I-' || m.term FROM many m JOIN vocab v ON contains(v.w, m.term) WHERE m.r % 3 = 2),
hit AS (SELECT DISTINCT t.org_id, c.code FROM toks t JOIN calls c ON c.w = t.w)
SELECT org_id, code FROM hit WHERE NOT (code LIKE 'I-%' AND org_id IN (SELECT org_id FROM toks WHERE w = 'the'))
UNION ALL SELECT org_id, 'MAIL' AS code FROM corpus WHERE regexp_matches(corpus, '[0-9]+@|@[0-9]')""")
def tag_indexed_rules(spark, sf):
    """Five thousand rules as a table: whole words, beginnings of words, parts of words unless another word stands, and one without letters."""
    known = term_table(spark, sf).select("term", "df").distinct().where(F.col("term").rlike("^[a-z]{3,}$"))
    r = F.row_number().over(Window.orderBy(F.desc("df"), "term"))  # numbers the terms of the vocabulary, to make rules of
    listed = known.withColumn("r", r).where("r <= 5000")
    kind = F.element_at(F.array(*map(F.lit, "WBI")), (F.col("r") % 3 + 1).cast("int"))
    left = F.when(F.col("r") % 3 == 2, "").otherwise(EDGE_L)
    right = F.when(F.col("r") % 3 == 0, EDGE_R).otherwise("")
    made = listed.select(F.concat(kind, F.lit("-"), "term").alias("code"), F.concat(left, "term", right).alias("include"), F.when(kind == "I", words("the")).alias("exclude"))
    mail = spark.createDataFrame([("MAIL", "[0-9]+@|@[0-9]", None), ("NONE", r"\b()\b", None)], made.schema)
    return rules.tag_by_rules(corpus(spark, sf), made.unionByName(mail))

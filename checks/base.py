"""Registry of queries, and how the given tables stand in for the real inputs.

Every stand-in exists twice: as a DataFrame here and as a common table
expression of the same name for the checking SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.functions import text as tx
from tagspark.functions.codes import code_set, split_codes
from tagspark.operators import features, rules, term_lists
from tagspark.session import shared_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query, with checking SQL over the named expressions."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql, uses)
        return fn
    return keep


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    CTES[name] = (sql, uses)


def with_ctes(sql: str, uses: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for written files, in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"


def rows6(df: DataFrame, *cols: str) -> DataFrame:
    """Round score columns to 6 places so that sums in another order agree."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# --- fixed values: the inline rule table ------------------------------------
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def words(*alternatives: str) -> str:
    return f"{EDGE_L}({'|'.join(alternatives)}){EDGE_R}"


RULES = [
    rules.Rule("EN101", words("the", "and")),
    rules.Rule("EN201", words("shat", "ered", "ther"), words("hat")),
    rules.Rule("FR101", words("pour", "par", "dans")),
    rules.Rule("DE201", words("und", "keit"), words("die")),
    rules.Rule("ES101", words("para", "por", "con")),
    rules.Rule("PR101", words("licen[cs]e", "copyright")),
    rules.Rule("PR201", r"[\p{L}\p{N}_.]+@[\p{L}\p{N}_.]+"),
    rules.Rule("ZZ100", r"\b()\b"),
]
# code, tag, level, related codes of the second taxonomy, reason not used
TAXONOMY = [
    ("EN", "English", 1, "A10", None),
    ("EN101", "Common words", 2, "A10;A20", None),
    ("EN200", "Rare words", 2, None, None),
    ("EN201", "Rare stems", 3, "A10; B10;", None),
    ("FR", "French", 1, "A20", None),
    ("FR101", "French words", 2, "A20", None),
    ("DE", "German", 1, "B10", None),
    ("DE201", "German words", 3, "B10", None),
    ("ES", "Spanish", 1, "B20", None),
    ("ES101", "Spanish words", 2, "B20;A20", None),
    ("PR", "Private", 1, None, None),
    ("PR101", "Licence", 2, None, None),
    ("PR201", "Mail", 3, "B10", None),
    ("TX", "Toxic", 1, None, None),
    ("TX201", "Toxic text", 3, None, "no rule"),
    ("ZZ100", "Nothing", 2, None, "empty"),
]
LANG_CODE = {"en": "EN101", "fr": "FR101", "de": "DE201", "es": "ES101"}
LANG_CLASS = {"en": "A10", "fr": "A20", "de": "B10", "es": "B20"}
CODE_CLASS = {LANG_CODE[k]: LANG_CLASS[k] for k in LANG_CODE}
COEFS = [
    ("the", "EN101", 3.0), ("and", "EN101", 2.0), ("that", "EN101", 1.25),
    ("pour", "FR101", 4.0), ("les", "FR101", 2.5), ("que", "FR101", 1.0),
    ("und", "DE201", 4.0), ("die", "DE201", 2.0), ("der", "DE201", 1.5),
    ("para", "ES101", 4.0), ("con", "ES101", 3.0), ("que", "ES101", 1.5), ("por", "ES101", 2.0),
    ("the", "TX201", 0.5), ("in", "TX201", 0.4), ("copyright", "PR101", 5.0), ("license", "PR101", 5.0),
]
INTERCEPTS = {
    "EN101": -2.0, "FR101": -2.1, "DE201": -2.2, "ES101": -2.3, "TX201": -1.9, "PR101": -2.4,
}


def _lit(x) -> str:
    if x is None:
        return "NULL"
    return repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows, *cols: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(cols)})"


def case(col: str, mapping: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items()) + " END"


def mapped(col, mapping: dict):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(col == k, v).otherwise(out)
    return out


# --- records, taxonomy, tags --------------------------------------------------
def records(spark, sf) -> DataFrame:
    d = spread(table(spark, sf, "documents"))
    return d.select(
        F.concat(F.lit("GB-CHC-"), F.col("doc_id").cast("string")).alias("org_id"),
        F.concat_ws(" ", "source", "lang").alias("name"),
        F.when(F.col("source") != "src3", F.col("text")).alias("activities"),
        F.col("text").alias("objects"),
        F.col("lang").alias("source"),
        (F.col("n_chars") * 1000.0).alias("income"),
        (F.col("source") != "src7").alias("active"),
    )


cte("records", """SELECT 'GB-CHC-' || doc_id AS org_id, source || ' ' || lang AS name,
  CASE WHEN source <> 'src3' THEN text END AS activities, text AS objects, lang AS source,
  CAST(n_chars * 1000 AS DOUBLE) AS income, source <> 'src7' AS active FROM documents""")
cte("corpus", "SELECT *, name || ' ' || coalesce(activities, objects, '') AS corpus FROM records", ("records",))


def corpus(spark, sf) -> DataFrame:
    return tx.text_corpus(records(spark, sf))


def taxonomy(spark) -> DataFrame:
    by_code = {r.code: r for r in RULES}
    rows = [
        (*t, by_code[t[0]].include if t[0] in by_code else None,
         by_code[t[0]].exclude if t[0] in by_code else None)
        for t in TAXONOMY
    ]
    return spark.createDataFrame(
        rows, "code string, tag string, level int, related string, not_used string, include string, exclude string"
    )


cte("taxonomy", values(TAXONOMY, "code", "tag", "level", "related", "not_used"))


def _rule_sql(rule: rules.Rule, source: str) -> str:
    out = f"SELECT org_id, '{rule.code}' AS code FROM {source} WHERE regexp_matches(corpus, {_lit(rule.include)}, 'i')"
    if rule.exclude:
        out += f" AND NOT regexp_matches(corpus, {_lit(rule.exclude)}, 'i')"
    return out


def tags(spark, sf) -> DataFrame:
    return rules.tag_by_rules(corpus(spark, sf), RULES)


cte("tags", " UNION ALL ".join(_rule_sql(r, "corpus") for r in RULES if r.code != "ZZ100"), ("corpus",))
GROUPED = """SELECT org_id, code FROM {0} UNION SELECT org_id, substr(code, 1, 2) FROM {0}
  UNION SELECT org_id, substr(code, 1, 3) || '00' FROM {0} WHERE regexp_matches(substr(code, 3, 1), '^[2-9]$')"""
cte("group_tags", GROUPED.format("tags"), ("tags",))


def group_tags(spark, sf) -> DataFrame:
    return rules.expand_groups(tags(spark, sf)).distinct()


# --- gold labels and evaluation rows --------------------------------------------
def gold(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels").select(
        F.concat(F.lit("GB-CHC-"), F.col("doc_id").cast("string")).alias("org_id"), "quality", "toxic"
    )
    g = corpus(spark, sf).join(lab, "org_id")
    lang = F.col("source")
    return g.withColumns(
        {
            "tags": F.concat(mapped(lang, LANG_CODE), F.when(F.col("toxic") == 1, ";TX201").otherwise("")),
            "class_code": mapped(lang, LANG_CLASS),
        }
    )


cte("gold", f"""SELECT c.*, l.quality, l.toxic,
  {case('c.source', LANG_CODE)} || CASE WHEN toxic = 1 THEN ';TX201' ELSE '' END AS tags,
  {case('c.source', LANG_CLASS)} AS class_code
  FROM corpus c JOIN labels l ON c.org_id = 'GB-CHC-' || l.doc_id""", ("corpus",))
cte("truth", """SELECT DISTINCT org_id, trim(x) AS code FROM
  (SELECT org_id, unnest(string_split(tags, ';')) AS x FROM gold) WHERE trim(x) <> ''""", ("gold",))
cte("pred", "SELECT t.org_id, t.code FROM tags t WHERE t.org_id IN (SELECT org_id FROM gold)", ("tags", "gold"))


def eval_rows(spark, sf) -> DataFrame:
    return rules.tag_by_rules_eval(gold(spark, sf), RULES)


def metrics_sql(members: str, truth: str, pred: str, by: str = "") -> str:
    """Multi-label metrics out of (by, org_id), (by, org_id, code) x 2."""
    b = f"{by}, " if by else ""
    on = f"AND t.{by} = p.{by}" if by else ""
    gb = f"GROUP BY {by}" if by else ""
    key = f"{by}, " if by else ""
    first = f"coalesce(t.{by}, p.{by}) AS {by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    lead = f"{by}, " if by else ""
    rid = f"m.{by} = s.{by} AND" if by else ""
    return f"""
  cells AS (SELECT {first}coalesce(t.org_id, p.org_id) AS org_id, coalesce(t.code, p.code) AS code,
     CASE WHEN t.code IS NOT NULL AND p.code IS NOT NULL THEN 1 ELSE 0 END AS tp,
     CASE WHEN t.code IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN p.code IS NULL THEN 1 ELSE 0 END AS fn
     FROM {truth} t FULL JOIN {pred} p ON t.org_id = p.org_id AND t.code = p.code {on}),
  per_code AS (SELECT {b}code, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY {b}code),
  label_side AS (SELECT {b}sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS labels,
     avg(2.0 * tp / (2 * tp + fp + fn)) AS f1_macro FROM per_code {gb}),
  per_row AS (SELECT {b}org_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY {b}org_id),
  row_side AS (SELECT {'m.' + by + ', ' if by else ''}count(*) AS rows,
     avg(CASE WHEN coalesce(fp, 0) + coalesce(fn, 0) = 0 THEN 1.0 ELSE 0.0 END) AS subset_accuracy,
     avg(CASE WHEN s.org_id IS NULL THEN 0.0 ELSE s.tp * 1.0 / (s.tp + s.fp + s.fn) END) AS jaccard_samples
     FROM {members} m LEFT JOIN per_row s ON {rid} m.org_id = s.org_id {'GROUP BY m.' + by if by else ''}),
  measured AS (SELECT {lead}CAST(rows AS BIGINT) AS rows,
     CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision_micro,
     CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall_micro,
     CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1_micro,
     f1_macro, subset_accuracy, jaccard_samples, (fp + fn) * 1.0 / (rows * labels) AS hamming_loss
     FROM label_side JOIN row_side {join})"""


METRIC_COLS = [
    "precision_micro", "recall_micro", "f1_micro", "f1_macro", "subset_accuracy",
    "jaccard_samples", "hamming_loss",
]
METRIC_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_COLS)
OBJECTIVE_SQL = "0.35 * f1_micro + 0.40 * f1_macro + 0.25 * recall_micro"


# --- long features and fixed-coefficient scores ------------------------------------
def term_table(spark, sf, min_df: int = 3, keep_part: bool = False) -> DataFrame:
    toks = corpus(spark, sf).select("org_id", tx.word_tokens(F.col("corpus")).alias("tokens"))
    return features.term_counts(toks, "tokens", min_df, keep_part=keep_part)


def weights(spark, sf) -> DataFrame:
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    return features.tfidf_l2(term_table(spark, sf, keep_part=True), n)


def scored_weights(spark, sf, coefs) -> DataFrame:
    """The weights of the terms that have a coefficient, as scores read them; all terms of a record count for its length."""
    toks = corpus(spark, sf).select("org_id", tx.word_tokens(F.col("corpus")).alias("tokens"))
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    return term_lists.wanted_weights(toks, "tokens", n, coefs, 3, between=" ")


TOKEN = r"'[\p{L}\p{N}_]{2,}'"
cte("token_rows", f"SELECT org_id, unnest(regexp_extract_all(lower(corpus), {TOKEN})) AS term FROM corpus", ("corpus",))
cte("tf", "SELECT org_id, term, count(*) AS tf FROM token_rows GROUP BY ALL", ("token_rows",))
cte("dfs", "SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3", ("tf",))
cte("term_table", "SELECT tf.org_id, tf.term, tf.tf, dfs.df FROM tf JOIN dfs ON tf.term = dfs.term", ("tf", "dfs"))
cte("raw_weights", """SELECT org_id, term, tf * (ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + df)) + 1.0) AS w
  FROM term_table""", ("term_table", "corpus"))
cte("weights", """SELECT org_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY org_id)) AS weight
  FROM raw_weights""", ("raw_weights",))
cte("coefs", values(COEFS, "term", "code", "coef"))
cte("intercepts", values(INTERCEPTS.items(), "code", "b"))
cte("scores", """SELECT r.org_id, i.code,
  1.0 / (1.0 + exp(-(any_value(i.b) + coalesce(sum(w.weight * c.coef), 0)))) AS score
  FROM records r CROSS JOIN intercepts i
  LEFT JOIN coefs c ON c.code = i.code LEFT JOIN weights w ON w.term = c.term AND w.org_id = r.org_id
  GROUP BY r.org_id, i.code""", ("records", "intercepts", "coefs", "weights"))
cte("ranks", """SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC, code) AS rn,
  max(score) OVER (PARTITION BY org_id) AS best FROM scores""", ("scores",))


def scores(spark, sf) -> DataFrame:
    c = spark.createDataFrame(COEFS, "term string, code string, coef double")
    return features.score_labels(scored_weights(spark, sf, c), c, INTERCEPTS, records=records(spark, sf))


def score_lists(spark, sf) -> DataFrame:
    c = spark.createDataFrame(COEFS, "term string, code string, coef double")
    return features.score_lists(scored_weights(spark, sf, c), c, INTERCEPTS, records=records(spark, sf))


def class_scores(spark, sf) -> DataFrame:
    code = mapped(F.col("code"), CODE_CLASS)
    return scores(spark, sf).withColumn("code", code).where(F.col("code").isNotNull())


cte("class_scores", f"""SELECT org_id, {case('code', CODE_CLASS)} AS code, score FROM scores
  WHERE {case('code', CODE_CLASS)} IS NOT NULL""", ("scores",))
cte("class_ranks", """SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC, code) AS rn
  FROM class_scores""", ("class_scores",))


cte("class_pairs", """SELECT g.class_code AS y, c.code AS p FROM gold g
  JOIN class_ranks c ON g.org_id = c.org_id AND c.rn = 1""", ("gold", "class_ranks"))


# --- hand-made labels: turns of a conversation label a record --------------------------
def stacked(spark, sf) -> DataFrame:
    """Manual labels in stacking order; system turns carry none."""
    c = table(spark, sf, "conversations")
    tag = F.when(F.col("role") == "user", "EN101; PR101").when(F.col("role") == "assistant", "FR101")
    return c.select(
        F.concat(F.lit("GB-CHC-"), F.col("conv_id").cast("string")).alias("org_id"),
        F.col("turn").alias("file_ord"),
        F.length("text").alias("row_ord"),
        F.when(F.length("text") > 100, tag).alias("tags"),
        F.when(F.col("role") == "assistant", "B20").alias("class_code"),
    )


cte("stacked", """SELECT 'GB-CHC-' || conv_id AS org_id, turn AS file_ord, length(text) AS row_ord,
  CASE WHEN length(text) > 100 THEN CASE role WHEN 'user' THEN 'EN101; PR101' WHEN 'assistant' THEN 'FR101' END END AS tags,
  CASE WHEN role = 'assistant' THEN 'B20' END AS class_code FROM conversations""")
cte("manual_tags", """SELECT org_id, arg_min(tags, (file_ord, row_ord)) AS tags FROM stacked
  WHERE tags IS NOT NULL GROUP BY org_id""", ("stacked",))
cte("manual_class", """SELECT org_id, arg_min(class_code, (file_ord, row_ord)) AS class_code FROM stacked
  WHERE class_code IS NOT NULL GROUP BY org_id""", ("stacked",))
cte("manual_long", """SELECT DISTINCT org_id, trim(x) AS code FROM
  (SELECT org_id, unnest(string_split(tags, ';')) AS x FROM manual_tags)""", ("manual_tags",))


def truth_sets(df: DataFrame) -> DataFrame:
    return df.withColumn("true_codes", code_set(split_codes(F.col("tags"))))

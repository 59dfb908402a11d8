"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    class_scores,
    corpus,
    gold,
    group_tags,
    query,
    records,
    table,
    taxonomy,
    values,
    with_ctes,
)
from tagspark import fixed
from tagspark.functions import codes as cd
from tagspark.functions import text as tx
from tagspark.operators import aggregates, ranking, registry, text_ops

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.stopwords()) + "]"
_CLEAN = r"""array_to_string(list_filter(string_split(
  regexp_replace(regexp_replace(lower({0}), '[/(){{}}\[\]|@,;]', ' ', 'g'), '[^0-9a-z #+_]', '', 'g'), ' '),
  lambda x: x <> '' AND NOT list_contains({1}, x)), ' ')"""


def clean_sql(col: str) -> str:
    return _CLEAN.format(col, _STOP)


@query("conform_registry", """SELECT 'GB-CHC-' || c_custkey AS org_id, CAST(c_custkey AS VARCHAR) AS reg_number, c_name AS name,
  c_acctbal AS income, 'ccew' AS source, c_mktsegment = 'BUILDING' AS active, NULL::VARCHAR AS postcode FROM customer""")
def conform_registry(spark, sf):
    c = registry.build_org_id(table(spark, sf, "customer"), "c_custkey", "GB-CHC-")
    c = registry.derive_active(c, "equals", "c_mktsegment", "BUILDING")
    out = registry.conform_registry(
        c, {"org_id": "org_id", "reg_number": "c_custkey", "name": "c_name", "income": "c_acctbal", "active": "active"},
        {"source": "ccew"},
    )
    assert out.columns == fixed.RECORD_FIELDS
    return out.select("org_id", "reg_number", "name", "income", "source", "active", "postcode")


@query("filter_main_entity", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 0")
def filter_main_entity(spark, sf):
    return registry.filter_main_entity(table(spark, sf, "customer"), "c_nationkey").select("c_custkey", "c_name")


@query("derive_active", """SELECT o_orderkey, o_orderstatus = 'F' AS by_status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END IS NULL AS by_date,
  nullif(o_orderstatus, 'P') IS DISTINCT FROM 'O' AS by_difference FROM orders""")
def derive_active(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        registry.active_flag("equals", s, "F").alias("by_status"),
        registry.active_flag("is_null", F.when(s == "F", F.col("o_orderdate"))).alias("by_date"),
        registry.active_flag("differs", F.nullif(s, F.lit("P")), "O").alias("by_difference"),
    )


@query("build_org_id", "SELECT s_suppkey, 'GB-SC-' || s_suppkey AS org_id FROM supplier")
def build_org_id(spark, sf):
    return registry.build_org_id(table(spark, sf, "supplier"), "s_suppkey", "GB-SC-").select("s_suppkey", "org_id")


_REG = "CASE p_size % 3 WHEN 0 THEN 'NIC' || p_partkey WHEN 1 THEN 'SC' || p_partkey ELSE CAST(p_partkey * 1000 AS VARCHAR) END"


@query("regnumber_to_orgid", f"""SELECT p_partkey, CASE WHEN r LIKE 'N%' THEN 'GB-NIC-' || regexp_replace(r, '[^0-9]', '', 'g')
  WHEN r LIKE 'S%' THEN 'GB-SC-SC' || CASE WHEN length(d) < 6 THEN lpad(d, 6, '0') ELSE d END ELSE 'GB-CHC-' || r END AS org_id
  FROM (SELECT *, regexp_replace(r, '[^0-9]', '', 'g') AS d FROM (SELECT p_partkey, {_REG} AS r FROM part))""")
def regnumber_to_orgid(spark, sf):
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_size") % 3
    r = F.when(kind == 0, F.concat(F.lit("NIC"), key)).when(kind == 1, F.concat(F.lit("SC"), key)).otherwise(
        (F.col("p_partkey") * 1000).cast("string")
    )
    return table(spark, sf, "part").select("p_partkey", tx.regnumber_to_orgid(r).alias("org_id"))


@query("postcode_from_address", """SELECT doc_id, list_extract(string_split(coalesce(text, ''), ', '), -1) AS postcode FROM documents""")
def postcode_from_address(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.postcode_from_address(F.col("text")).alias("postcode"))


@query("flatten_newlines", """SELECT org_id, replace(coalesce(activities, ''), chr(10), ' ') AS activities,
  replace(objects, chr(10), ' ') AS objects FROM records""", ("records",))
def flatten_newlines(spark, sf):
    return tx.flatten_newlines(records(spark, sf), ["activities", "objects"]).select("org_id", "activities", "objects")


@query("text_corpus", "SELECT org_id, corpus FROM corpus", ("corpus",))
def text_corpus(spark, sf):
    return corpus(spark, sf).select("org_id", "corpus")


@query("clean_text", f"SELECT org_id, {clean_sql('corpus')} AS cleaned FROM corpus", ("corpus",))
def clean_text(spark, sf):
    return corpus(spark, sf).select("org_id", tx.clean_text(F.col("corpus")).alias("cleaned"))


@query("stopwords", f"""SELECT term, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS term
  FROM documents) WHERE list_contains({_STOP}, term) GROUP BY term""")
def stopwords(spark, sf):
    terms = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")
    rows = table(spark, sf, "documents").select(F.explode(terms).alias("term"))
    return aggregates.group_size(rows.where(F.col("term").isin(tx.stopwords())), ["term"])


# The lexicon is the list of words seen with a final "s" that are also seen without.
_LEX = """SELECT DISTINCT s.term AS surface, b.term AS lemma FROM dfs s JOIN dfs b ON s.term = b.term || 's'"""


def _lexicon(spark, sf):
    from checks.base import term_table

    known = term_table(spark, sf).select("term").distinct()
    return known.select((F.concat("term", F.lit("s"))).alias("surface"), F.col("term").alias("lemma")).join(
        known.select(F.col("term").alias("surface")), "surface"
    )


@query("clean_text_lexicon", f"""SELECT c.org_id, coalesce((SELECT string_agg(coalesce(x.lemma, t.term), ' ' ORDER BY pos) FROM
  (SELECT unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT list_filter(string_split({clean_sql('c.corpus')}, ' '), lambda v: v <> '') AS w)) t
  LEFT JOIN ({_LEX}) x ON t.term = x.surface), '') AS cleaned FROM corpus c""", ("dfs", "corpus"))
def clean_text_lexicon(spark, sf):
    out = text_ops.cleaned(corpus(spark, sf), "corpus", _lexicon(spark, sf), out="cleaned")
    return out.select("org_id", "cleaned")


@query("lemma_lookup", f"""SELECT org_id, array_to_string(list(coalesce(x.lemma, t.term) ORDER BY pos), ' ') AS lemmas FROM
  (SELECT org_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM
    (SELECT org_id, regexp_extract_all(lower(corpus), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM corpus)) t
  LEFT JOIN ({_LEX}) x ON t.term = x.surface GROUP BY org_id""", ("dfs", "corpus"))
def lemma_lookup(spark, sf):
    lexicon = _lexicon(spark, sf)
    rows = corpus(spark, sf).select("org_id", tx.word_tokens(F.col("corpus")).alias("tokens"))
    out = text_ops.lemma_lookup(rows, "tokens", lexicon)
    return out.select("org_id", F.array_join("lemmas", " ").alias("lemmas"))


_ENDINGS = values(fixed.NOUN_ENDINGS, "old", "new")


@query("lemma_endings", with_ctes("", ("corpus", "dfs", "token_rows")).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
lexicon AS (SELECT term AS word FROM dfs WHERE length(term) <= 4 OR NOT ends_with(term, 's')),
listed AS (SELECT term AS surface, substr(term, 1, length(term) - 2) AS form FROM dfs WHERE ends_with(term, 'on')),
surfaces AS (SELECT DISTINCT term AS surface FROM token_rows),
grown AS (SELECT surface, surface AS form, 0 AS level FROM surfaces
  UNION SELECT g.surface, left(g.form, length(g.form) - length(e.old)) || e.new, g.level + 1 FROM grown g JOIN ({_ENDINGS}) e ON ends_with(g.form, e.old)
  WHERE g.level < 1 OR length(g.surface) <= 100),
forms AS (SELECT surface, form, greatest(level, 1) AS level FROM grown WHERE surface NOT IN (SELECT surface FROM listed)
  UNION ALL SELECT surface, form, 1 FROM listed UNION ALL SELECT surface, surface, 1 FROM listed),
best AS (SELECT surface, form FROM forms WHERE form IN (SELECT word FROM lexicon)
  QUALIFY row_number() OVER (PARTITION BY surface ORDER BY level, length(form), form) = 1),
toks AS (SELECT org_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT org_id, regexp_extract_all(lower(corpus), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM corpus))
SELECT org_id, string_agg(coalesce(b.form, t.term), ' ' ORDER BY pos) AS lemmas FROM toks t LEFT JOIN best b ON b.surface = t.term GROUP BY org_id""")
def lemma_endings(spark, sf):
    """Base forms by ending rules and exceptions, for words that the lexicon does not list too."""
    from checks.base import term_table

    known = term_table(spark, sf).select("term").distinct()
    lexicon = known.where((F.length("term") <= 4) | ~F.endswith("term", F.lit("s"))).select(F.col("term").alias("word"))
    listed = known.where(F.endswith("term", F.lit("on"))).select(F.col("term").alias("surface"), F.expr("substring(term, 1, length(term) - 2)").alias("lemma"))
    rows = corpus(spark, sf).select("org_id", tx.word_tokens(F.col("corpus")).alias("tokens"))
    return text_ops.lemmatise(rows, "tokens", lexicon, listed).select("org_id", F.array_join("lemmas", " ").alias("lemmas"))


@query("word_tokens", "SELECT org_id, array_to_string(regexp_extract_all(lower(corpus), '[\\p{L}\\p{N}_]{2,}'), ' ') AS tokens FROM corpus", ("corpus",))
def word_tokens(spark, sf):
    return corpus(spark, sf).select("org_id", F.array_join(tx.word_tokens(F.col("corpus")), " ").alias("tokens"))


@query("word_ngrams", """SELECT gram, count(*) AS n FROM (
  SELECT unnest(w) AS gram FROM (SELECT regexp_extract_all(lower(corpus), '[\\p{L}\\p{N}_]{2,}') AS w FROM corpus)
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM (SELECT regexp_extract_all(lower(corpus), '[\\p{L}\\p{N}_]{2,}') AS w FROM corpus)) GROUP BY gram""", ("corpus",))
def word_ngrams(spark, sf):
    toks = corpus(spark, sf).select(tx.word_tokens(F.col("corpus")).alias("w"))
    grams = toks.select(F.explode(tx.word_ngrams(F.col("w"), 2)).alias("gram"))
    return aggregates.group_size(grams, ["gram"])


@query("char_wb_ngrams", r"""SELECT gram, count(*) AS n FROM (SELECT unnest(flatten(list_transform(range(3, greatest(least(length(w), 5), 3) + 1),
    lambda n: list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n))))) AS gram FROM
  (SELECT ' ' || unnest(list_filter(regexp_split_to_array(lower(corpus), '[\t-\r\x{1c}-\x{1f} \x{85}\p{Z}]+'), lambda x: x <> '')) || ' ' AS w FROM corpus))
  GROUP BY gram""", ("corpus",))
def char_wb_ngrams(spark, sf):
    grams = corpus(spark, sf).select(F.explode(tx.char_wb_ngrams(F.col("corpus"), 5)).alias("gram"))
    return aggregates.group_size(grams, ["gram"])


@query("split_codes", """SELECT org_id, trim(x) AS code FROM (SELECT org_id, unnest(string_split(coalesce(tags, ''), ';')) AS x FROM stacked)
  WHERE trim(x) <> ''""", ("stacked",))
def split_codes(spark, sf):
    from checks.base import stacked

    return stacked(spark, sf).select("org_id", F.explode(cd.split_codes(F.col("tags"))).alias("code"))


@query("join_codes", """SELECT c.org_id, coalesce(string_agg(DISTINCT t.code, ';' ORDER BY t.code), '') AS codes
  FROM corpus c LEFT JOIN tags t ON c.org_id = t.org_id GROUP BY c.org_id""", ("corpus", "tags"))
def join_codes(spark, sf):
    from checks.base import RULES
    from tagspark.operators import rules

    return rules.tag_sets(corpus(spark, sf), RULES).select("org_id", cd.join_codes(F.col("codes")).alias("codes"))


def _band_sql(col: str, edges, labels) -> str:
    out = f"CASE WHEN {col} <= {edges[0]} THEN NULL"
    for hi, label in zip(edges[1:], labels, strict=True):
        out += f" WHEN {col} <= {hi} THEN '{label}'" if hi != float("inf") else f" WHEN {col} IS NOT NULL THEN '{label}'"
    return out + " END"


@query("income_band", f"""SELECT l_orderkey, l_linenumber, l_partkey, {_band_sql('l_extendedprice', fixed.INCOME_EDGES, fixed.INCOME_LABELS)} AS band,
  {_band_sql('l_extendedprice', fixed.SAMPLE_EDGES, fixed.SAMPLE_LABELS)} AS sample_band,
  {_band_sql('l_tax * 10', fixed.PROBABILITY_EDGES, fixed.PROBABILITY_LABELS)} AS share_band FROM lineitem""")
def income_band(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        cd.income_band(price, fixed.INCOME_EDGES, fixed.INCOME_LABELS).alias("band"),
        cd.income_band(price, fixed.SAMPLE_EDGES, fixed.SAMPLE_LABELS).alias("sample_band"),
        cd.band(F.col("l_tax") * 10, fixed.PROBABILITY_EDGES, fixed.PROBABILITY_LABELS).alias("share_band"),
    )


@query("taxonomy_code", """SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), nullif(p_brand, 'Brand#1'), p_name) AS code FROM part""")
def taxonomy_code(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("sub_group"),
        F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("group"),
        F.col("p_name").alias("section"),
    )
    return aggregates.taxonomy_code(p).select("p_partkey", "code")


@query("taxonomy_prune", """SELECT p_partkey, p_name, p_brand FROM part WHERE nullif(p_type, 'ECONOMY') IS NULL""")
def taxonomy_prune(spark, sf):
    p = table(spark, sf, "part").withColumn("not_used", F.nullif(F.col("p_type"), F.lit("ECONOMY")))
    return aggregates.taxonomy_prune(p, "not_used", ["p_partkey", "p_name", "p_brand"])


@query("expand_groups", "SELECT org_id, code FROM group_tags", ("group_tags",))
def expand_groups(spark, sf):
    return group_tags(spark, sf)


@query("section_of", "SELECT org_id, substr(class_code, 1, 1) AS section FROM gold", ("gold",))
def section_of(spark, sf):
    return gold(spark, sf).select("org_id", cd.section_of(F.col("class_code")).alias("section"))


@query("prefix_match", """SELECT DISTINCT t.org_id, x.code FROM group_tags t JOIN taxonomy x ON starts_with(t.code, x.code)""",
       ("group_tags", "taxonomy"))
def prefix_match(spark, sf):
    return aggregates.prefix_match(group_tags(spark, sf), taxonomy(spark)).select("org_id", "code")


@query("corpus_length", "SELECT org_id, CAST(length(corpus) AS INTEGER) AS corpus_length FROM corpus", ("corpus",))
def corpus_length(spark, sf):
    return tx.corpus_length(records(spark, sf)).select("org_id", "corpus_length")


@query("round_score", """SELECT p_partkey, round_even(p_retailprice / 7, 3) AS three, round_even(p_retailprice / 7, 4) AS four FROM part""")
def round_score(spark, sf):
    x = F.col("p_retailprice") / 7
    return table(spark, sf, "part").select(
        "p_partkey", cd.round_score(x, 3).alias("three"), cd.round_score(x, 4).alias("four")
    )


@query("cap_bucket", """SELECT CASE WHEN n >= 15 THEN '15 or over' ELSE CAST(n AS VARCHAR) END AS bucket, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent
  FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1""")
def cap_bucket(spark, sf):
    counts = aggregates.group_size(table(spark, sf, "orders"), ["o_custkey"], "n_codes")
    return aggregates.cap_bucket(counts)


@query("exact_match_flags", """SELECT g.org_id, g.class_code = c.code AS correct, substr(g.class_code, 1, 1) = substr(c.code, 1, 1) AS sector_correct
  FROM gold g JOIN class_ranks c ON g.org_id = c.org_id AND c.rn = 1""", ("gold", "class_ranks"))
def exact_match_flags(spark, sf):
    best = ranking.argmax_class(class_scores(spark, sf), out="predicted")
    rows = gold(spark, sf).join(best, "org_id")
    return aggregates.exact_match_flags(rows, "class_code", "predicted").select("org_id", "correct", "sector_correct")


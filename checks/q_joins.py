"""Joins, hand-made labels and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    corpus,
    eval_rows,
    gold,
    query,
    records,
    scores,
    stacked,
    table,
    tags,
    taxonomy,
)
from tagspark.functions.codes import join_codes, union_codes
from tagspark.operators import aggregates, decide, joins, ranking, registry


@query("left_lookup", """SELECT c_custkey, c_name, o.o_orderpriority, o.o_orderdate::DATE AS o_orderdate FROM customer LEFT JOIN
  (SELECT o_custkey, arg_min((o_orderdate, o_orderpriority), (o_orderdate, o_orderpriority, o_orderkey)) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) x ON c_custkey = o_custkey
  LEFT JOIN LATERAL (SELECT x.m[1] AS o_orderdate, x.m[2] AS o_orderpriority) o ON true""")
def left_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = joins.left_lookup(c, o, "c_custkey", ["o_orderdate", "o_orderpriority"], F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderpriority", "o_orderkey"])
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("left_lookup_gaps", """SELECT c_custkey, a, b FROM customer LEFT JOIN (SELECT o_custkey,
  min(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END) AS a, min(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS b
  FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def left_lookup_gaps(spark, sf):
    """Keys repeat, and each column has nulls that must hide no value."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("a"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("b"),
    )
    return joins.left_lookup(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", ["a", "b"])


@query("left_lookup_default", """SELECT c_custkey, coalesce(big, false) AS big FROM customer LEFT JOIN
  (SELECT o_custkey, min(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice > 250000 END) AS big FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON c_custkey = o_custkey""")
def left_lookup_default(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 250000).alias("big")
    )
    return joins.left_lookup_default(c, o, "c_custkey", "big", False, F.col("o_orderpriority") == "1-URGENT")


@query("left_lookup_activities", """SELECT l.doc_id, l.quality, d.activities FROM labels l LEFT JOIN
  (SELECT doc_id, min(activities) AS activities FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN text END AS activities FROM documents
   UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'zz ' || source END FROM documents) GROUP BY doc_id) d ON l.doc_id = d.doc_id""")
def left_lookup_activities(spark, sf):
    d = table(spark, sf, "documents")
    text = d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("activities"))
    more = d.select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("zz "), "source")).otherwise("  ").alias("activities"))
    return joins.left_lookup_activities(table(spark, sf, "labels").select("doc_id", "quality"), text.unionByName(more), "doc_id")


@query("name_join", """SELECT t.org_id, t.code, r.name, x.tag AS code_name FROM tags t LEFT JOIN records r ON t.org_id = r.org_id
  LEFT JOIN taxonomy x ON t.code = x.code""", ("tags", "records", "taxonomy"))
def name_join(spark, sf):
    out = joins.name_join(tags(spark, sf), records(spark, sf), taxonomy(spark))
    return out.select("org_id", "code", "name", "code_name")


@query("labels_join", """SELECT c.c_custkey, c.n_nationkey, n.n_name, r.r_name FROM
  (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) c LEFT JOIN nation n ON c.n_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def labels_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    classes = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    titles = joins.left_lookup(n, r, "n_regionkey", ["r_name"]).withColumnRenamed("n_nationkey", "code")
    out = joins.labels_join(c, classes, titles, "c_custkey", "n_nationkey")
    return out.select("c_custkey", "n_nationkey", "n_name", "r_name")


@query("first_label", "SELECT org_id, tags FROM manual_tags", ("manual_tags",))
def first_label(spark, sf):
    return joins.first_label(stacked(spark, sf), "tags")


@query("override_single", """SELECT b.org_id, coalesce(m.class_code, b.code) AS class_code,
  CASE WHEN m.class_code IS NULL THEN round(b.score, 6) END AS class_code_probability,
  CASE WHEN m.class_code IS NULL THEN 'ml_model' ELSE 'manual' END AS class_code_source
  FROM ranks b LEFT JOIN manual_class m ON b.org_id = m.org_id WHERE b.rn = 1""", ("ranks", "manual_class"))
def override_single(spark, sf):
    best = ranking.argmax_class(scores(spark, sf)).withColumn("class_code_source", F.lit("ml_model"))
    out = joins.override_single(best, joins.first_label(stacked(spark, sf), "class_code"))
    return out.withColumn("class_code_probability", F.round("class_code_probability", 6))


def _manual(spark, sf):
    return joins.first_label(stacked(spark, sf), "tags")


@query("override_multi", """SELECT org_id, code FROM tags WHERE org_id NOT IN (SELECT org_id FROM manual_tags)
  UNION ALL SELECT org_id, code FROM manual_long""", ("tags", "manual_long"))
def override_multi(spark, sf):
    return joins.override_multi(tags(spark, sf), _manual(spark, sf))


@query("override_multi_append", "SELECT org_id, code FROM tags UNION ALL SELECT org_id, code FROM manual_long", ("tags", "manual_long"))
def override_multi_append(spark, sf):
    return joins.override_multi(tags(spark, sf), _manual(spark, sf), "append")


@query("override_multi_restricted", """SELECT org_id, code FROM tags WHERE org_id NOT IN (SELECT org_id FROM manual_tags WHERE org_id IN (SELECT org_id FROM gold))
  UNION ALL SELECT org_id, code FROM manual_long WHERE org_id IN (SELECT org_id FROM gold)""", ("tags", "manual_long", "gold"))
def override_multi_restricted(spark, sf):
    return joins.override_multi(tags(spark, sf), _manual(spark, sf), restrict_to_input=gold(spark, sf))


@query("anti_new_rows", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def anti_new_rows(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.anti_new_rows(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey")


_KEPT = "(SELECT s_suppkey AS k, s_name AS name, s_acctbal AS income, s_nationkey FROM supplier)"
_NEW = "(SELECT c_custkey AS k, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS income FROM customer)"


def _kept(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("income"), "s_nationkey")


def _new(spark, sf):
    c = table(spark, sf, "customer")
    bal = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), bal.alias("income"))


@query("upsert_columns", f"""SELECT s.k, coalesce(n.name, s.name) AS name, coalesce(n.income, s.income) AS income, s.s_nationkey
  FROM {_KEPT} s LEFT JOIN {_NEW} n ON s.k = n.k""")
def upsert_columns(spark, sf):
    return joins.upsert_columns(_kept(spark, sf), _new(spark, sf), "k", ["name", "income"])


@query("append_missing", f"""SELECT k, name, income, s_nationkey FROM {_KEPT}
  UNION ALL SELECT k, name, income, NULL FROM {_NEW} WHERE k NOT IN (SELECT s_suppkey FROM supplier)""")
def append_missing(spark, sf):
    return joins.append_missing(_kept(spark, sf), _new(spark, sf), "k")


@query("semi_member", """SELECT DISTINCT org_id FROM manual_long WHERE org_id IN (SELECT org_id FROM records)""", ("manual_long", "records"))
def semi_member(spark, sf):
    labelled = joins.override_multi(tags(spark, sf).where(F.lit(False)), _manual(spark, sf))
    return joins.semi_member(labelled, records(spark, sf))


_SETS = """SELECT r.org_id, coalesce((SELECT string_agg(code, ';' ORDER BY code) FROM scores s WHERE s.org_id = r.org_id AND s.score >= 0.2), '') AS model_codes,
  coalesce((SELECT string_agg(code, ';' ORDER BY code) FROM pred p WHERE p.org_id = r.org_id), '') AS rule_codes FROM records r"""


@query("align_predictions", _SETS, ("scores", "pred", "records"))
def align_predictions(spark, sf):
    model = decide.decide_threshold(scores(spark, sf), 0.2)
    out = joins.align_predictions(model, eval_rows(spark, sf))
    return out.select("org_id", join_codes(F.col("model_codes")).alias("model_codes"), join_codes(F.col("rule_codes")).alias("rule_codes"))


@query("count_join", """SELECT r.org_id, count(t.code) AS n_codes FROM records r LEFT JOIN tags t ON r.org_id = t.org_id GROUP BY r.org_id""", ("records", "tags"))
def count_join(spark, sf):
    return joins.count_join(records(spark, sf).select("org_id"), tags(spark, sf))


@query("taxonomy_counts", """SELECT x.code, x.tag, count(t.org_id) AS matched FROM taxonomy x LEFT JOIN tags t ON x.code = t.code GROUP BY x.code, x.tag""", ("taxonomy", "tags"))
def taxonomy_counts(spark, sf):
    return joins.taxonomy_counts(taxonomy(spark), tags(spark, sf)).select("code", "tag", "matched")


@query("mean_std_merge", """SELECT l_returnflag, l_linestatus, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_std,
  round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY ALL""")
def mean_std_merge(spark, sf):
    out = joins_mean_std(table(spark, sf, "lineitem"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith(("l_tax", "l_disc"))})


def joins_mean_std(df):
    return aggregates.mean_std_merge(df, ["l_returnflag", "l_linestatus"], ["l_tax", "l_discount"])


# --- set operations -----------------------------------------------------------
def registers(spark, sf):
    """Three tables in the unified columns."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    a = registry.conform_registry(
        c,
        {"org_id": F.concat(F.lit("GB-CHC-"), F.col("c_custkey").cast("string")), "reg_number": "c_custkey", "name": "c_name",
         "income": "c_acctbal", "active": registry.active_flag("equals", F.col("c_mktsegment"), "BUILDING"),
         "activities": F.concat_ws("\n", "c_mktsegment", "n_name")},
        {"source": "ccew"},
    )
    s = table(spark, sf, "supplier")
    b = registry.conform_registry(
        s,
        {"org_id": F.concat(F.lit("GB-SC-"), F.col("s_suppkey").cast("string")), "reg_number": "s_suppkey", "name": "s_name",
         "income": "s_acctbal", "active": registry.active_flag("is_null", F.when(F.col("s_nationkey") == 3, F.lit("x")))},
        {"source": "oscr"},
    )
    p = table(spark, sf, "part")
    n = registry.conform_registry(
        p,
        {"org_id": F.concat(F.lit("GB-NIC-"), F.col("p_partkey").cast("string")), "reg_number": F.concat(F.lit("NI"), F.col("p_partkey").cast("string")),
         "name": "p_name", "income": "p_retailprice", "objects": "p_type",
         "active": registry.active_flag("differs", F.col("p_type"), "ECONOMY")},
        {"source": "ccni"},
    )
    return a, b, n


REGISTERS_SQL = """SELECT 'GB-CHC-' || c_custkey AS org_id, CAST(c_custkey AS VARCHAR) AS reg_number, c_name AS name, c_acctbal AS income, c_mktsegment = 'BUILDING' AS active,
    c_mktsegment || ' ' || n_name AS activities, '' AS objects, 'ccew' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'GB-SC-' || s_suppkey, CAST(s_suppkey AS VARCHAR), s_name, s_acctbal, s_nationkey <> 3, '', '', 'oscr' FROM supplier
  UNION ALL SELECT 'GB-NIC-' || p_partkey, 'NI' || p_partkey, p_name, p_retailprice, p_type IS DISTINCT FROM 'ECONOMY', '', p_type, 'ccni' FROM part"""


@query("union_registers", f"SELECT org_id, reg_number, name, income, active, source FROM ({REGISTERS_SQL})")
def union_registers(spark, sf):
    return registry.union_registers(*registers(spark, sf)).select("org_id", "reg_number", "name", "income", "active", "source")


@query("union_codes", """SELECT r.org_id, coalesce((SELECT string_agg(DISTINCT code, ';' ORDER BY code) FROM
  (SELECT org_id, code FROM tags UNION ALL SELECT org_id, code FROM truth) u WHERE u.org_id = r.org_id), '') AS codes FROM gold r""",
       ("tags", "truth", "gold"))
def union_codes_(spark, sf):
    e = eval_rows(spark, sf)
    return e.select("org_id", F.array_join(union_codes(F.col("true_codes"), F.col("predicted_codes")), ";").alias("codes"))


@query("intersect_ids", """SELECT DISTINCT org_id FROM stacked INTERSECT SELECT org_id FROM records""", ("stacked", "records"))
def intersect_ids(spark, sf):
    return joins.intersect_ids(stacked(spark, sf), records(spark, sf))


_HALF = "(SELECT org_id, row_number() OVER (ORDER BY md5('{0}:' || org_id)) <= ceil(count(*) OVER () * 0.5) AS test FROM gold)"


@query("split_overlap", f"""SELECT org_id FROM {_HALF.format(1)} WHERE test INTERSECT SELECT org_id FROM {_HALF.format(2)} WHERE test""", ("gold",))
def split_overlap(spark, sf):
    g = gold(spark, sf).select("org_id")
    one, two = (ranking.split_holdout(g, test_size=0.5, seed=s) for s in (1, 2))
    joins.require_disjoint(*one)
    return joins.split_overlap(one[1], two[1])


@query("distinct_pairs", """SELECT org_id, code, min(method) AS method FROM (SELECT org_id, code, 'direct' AS method FROM tags
  UNION ALL SELECT org_id, substr(code, 1, 2), 'indirect' FROM tags WHERE length(code) > 2) GROUP BY org_id, code""", ("tags",))
def distinct_pairs(spark, sf):
    t = tags(spark, sf)
    extra = t.where(F.length("code") > 2).withColumn("code", F.substring("code", 1, 2))
    both = t.withColumn("method", F.lit("direct")).unionByName(extra.withColumn("method", F.lit("indirect")))
    return ranking.distinct_pairs(both)

"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import (
    GROUPED,
    RULES,
    group_tags,
    query,
    records,
    rows6,
    stacked,
    table,
    taxonomy,
    with_ctes,
    corpus,
    scratch,
)
from checks.q_aggregates import _category_sql
from checks.q_joins import REGISTERS_SQL, registers
from tagspark.operators import joins, registry, rules
from tagspark.plans import jobs, refresh
from tagspark.plans import registers as raw_registers


@query("job_unify", f"SELECT org_id, reg_number, name, income, active, activities, objects, source FROM ({REGISTERS_SQL})")
def job_unify(spark, sf):
    out = jobs.job_unify(registers(spark, sf))
    parts = out["active"].unionByName(out["inactive"])
    return parts.select("org_id", "reg_number", "name", "income", "active", "activities", "objects", "source")


@query("job_unify_top", f"""WITH u AS ({REGISTERS_SQL}),
kept AS (SELECT 'GB-SC-' || s_suppkey AS org_id, 'old ' || s_name AS name, s_acctbal AS income, 'kept' AS batch FROM supplier),
top AS (SELECT org_id, name, income FROM u WHERE active ORDER BY income DESC NULLS LAST, org_id LIMIT 300),
listed AS (SELECT * FROM kept UNION ALL SELECT org_id, name, income, NULL FROM top WHERE org_id NOT IN (SELECT org_id FROM kept))
SELECT l.org_id, coalesce(u.name, l.name) AS name, coalesce(u.income, l.income) AS income, l.batch FROM listed l LEFT JOIN u ON l.org_id = u.org_id""")
def job_unify_top(spark, sf):
    s = table(spark, sf, "supplier")
    kept = s.select(
        F.concat(F.lit("GB-SC-"), F.col("s_suppkey").cast("string")).alias("org_id"),
        F.concat(F.lit("old "), "s_name").alias("name"), F.col("s_acctbal").alias("income"), F.lit("kept").alias("batch"),
    )
    return jobs.job_unify(registers(spark, sf), kept, 300)["top"].select("org_id", "name", "income", "batch")


def _raw_registers(spark, sf):
    """Given tables under the raw registers' column names."""
    o, n = table(spark, sf, "orders"), table(spark, sf, "nation")
    ccew = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("registered_charity_number"), (F.col("c_custkey") % 4).alias("linked_charity_number"), F.col("c_name").alias("charity_name"),
        F.lit("AB1").alias("charity_contact_postcode"), F.when(F.col("c_mktsegment") == "BUILDING", "Registered").otherwise("Removed").alias("charity_registration_status"),
        F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("charity_activities"), F.col("c_acctbal").alias("latest_income"), (F.col("c_acctbal") / 2).alias("latest_expenditure"),
        F.lit("2024-01-31").cast("date").alias("date_of_extract"),
    )
    papers = o.select(F.col("o_custkey").alias("registered_charity_number"), (F.col("o_orderkey") % 2).alias("linked_charity_number"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("charitable_objects"))
    returns = o.select(F.col("o_custkey").alias("registered_charity_number"), (F.col("o_orderstatus") == "F").alias("latest_fin_period_submitted_ind"), (F.col("o_totalprice") > 250000).alias("grant_making_is_main_activity"))
    oscr = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("Charity Number"), F.col("s_name").alias("Charity Name"), F.concat(F.lit("S "), F.col("s_nationkey").cast("string")).alias("Objectives"),
        F.when(F.col("s_nationkey") == 3, F.lit("2020-02-01").cast("date")).alias("Ceased Date"), F.col("s_acctbal").alias("Most recent year income"),
    )
    ccni = n.select(
        F.col("n_nationkey").alias("Reg charity number"), F.col("n_name").alias("Charity name"), F.when(F.col("n_regionkey") == 2, "Removed").when(F.col("n_regionkey") > 0, "Recently registered").alias("Status"),
        F.concat(F.lit("1 High Street, "), F.col("n_name"), F.lit(", BT"), F.col("n_nationkey").cast("string")).alias("Public address"), F.lit(5.0).alias("Total income"),
    )
    purposes = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("regno"), F.col("s_name").alias("what your organisation does"), F.lit("purposes").alias("charitable purposes"))
    return {
        "ccew": {"main": ccew, "governing_document": papers, "annual_return_part_a": returns},
        "oscr": {"main": oscr},
        "ccni": {"main": ccni, "activities": purposes},
    }


_RAW_COLS = ["org_id", "reg_number", "name", "postcode", "active", "date_removed", "activities", "objects", "source", "last_updated", "income", "spending", "grant_making_is_main_activity"]
_CCEW = """SELECT 'GB-CHC-' || c_custkey AS org_id, CAST(c_custkey AS VARCHAR) AS reg_number, c_name AS name, 'AB1' AS postcode, c_mktsegment = 'BUILDING' AS active,
  NULL::DATE AS date_removed, CASE WHEN c_nationkey > 5 THEN c_mktsegment END AS activities, x.o AS objects, 'ccew' AS source, DATE '2024-01-31' AS last_updated,
  c_acctbal AS income, c_acctbal / 2 AS spending, coalesce(y.g, false) AS grant_making_is_main_activity FROM customer
  LEFT JOIN (SELECT o_custkey, min(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END) AS o FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) x ON x.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, min(o_totalprice > 250000) AS g FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) y ON y.o_custkey = c_custkey WHERE c_custkey % 4 = 0"""
_OSCR = """SELECT 'GB-SC-' || s_suppkey AS org_id, CAST(s_suppkey AS VARCHAR) AS reg_number, s_name AS name, NULL::VARCHAR AS postcode, s_nationkey <> 3 AS active,
  CASE WHEN s_nationkey = 3 THEN DATE '2020-02-01' END AS date_removed, NULL::VARCHAR AS activities, 'S ' || s_nationkey AS objects, 'oscr' AS source, DATE '2025-05-05' AS last_updated,
  s_acctbal AS income, NULL::DOUBLE AS spending, NULL::BOOLEAN AS grant_making_is_main_activity FROM supplier"""
_CCNI = """SELECT 'GB-NIC-' || n_nationkey AS org_id, 'NI' || n_nationkey AS reg_number, n_name AS name, 'BT' || n_nationkey AS postcode, n_regionkey <> 2 AS active,
  NULL::DATE AS date_removed, w AS activities, CASE WHEN w IS NOT NULL THEN 'purposes' END AS objects, 'ccni' AS source, DATE '2025-05-05' AS last_updated,
  5.0::DOUBLE AS income, NULL::DOUBLE AS spending, NULL::BOOLEAN AS grant_making_is_main_activity FROM nation
  LEFT JOIN (SELECT s_nationkey, min(s_name) AS w FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""


def _unified(spark, sf, source):
    parts = _raw_registers(spark, sf)[source]
    as_of = F.lit("2025-05-05").cast("date")
    return raw_registers.unified(raw_registers.REGISTERS[source], parts["main"], parts, as_of).select(*_RAW_COLS)


@query("register_ccew", _CCEW)
def register_ccew(spark, sf):
    return _unified(spark, sf, "ccew")


@query("register_oscr", _OSCR)
def register_oscr(spark, sf):
    return _unified(spark, sf, "oscr")


@query("register_ccni", _CCNI)
def register_ccni(spark, sf):
    return _unified(spark, sf, "ccni")


@query("job_unify_raw", f"""SELECT org_id, name, active, coalesce(activities, '') AS activities, coalesce(objects, '') AS objects, source, income
  FROM ({_CCEW} UNION ALL {_OSCR} UNION ALL {_CCNI})""")
def job_unify_raw(spark, sf):
    out = jobs.job_unify_raw(_raw_registers(spark, sf), as_of=F.lit("2025-05-05").cast("date"))
    parts = out["active"].unionByName(out["inactive"])
    return parts.select("org_id", "name", "active", "activities", "objects", "source", "income")


@query("unify_then_tag", "SELECT org_id, code FROM tags", ("tags",))
def unify_then_tag(spark, sf):
    """Three registers, one without activities and one with blank ones: their objects are tagged all the same."""
    r = records(spark, sf).withColumn("text", F.coalesce("activities", "objects"))
    kinds = [
        registry.conform_registry(r.where(F.col("source") == "en"), {"org_id": "org_id", "name": "name", "activities": "text", "active": "active"}, {"source": "a"}),
        registry.conform_registry(r.where(F.col("source") == "fr"), {"org_id": "org_id", "name": "name", "objects": "text", "active": "active"}, {"source": "b"}),
        registry.conform_registry(r.where(~F.col("source").isin("en", "fr")), {"org_id": "org_id", "name": "name", "objects": "text", "active": "active", "activities": F.lit("  ")}, {"source": "c"}),
    ]
    unified = jobs.job_unify(kinds)["all"]
    return jobs.job_tag_rules(unified, RULES, ordered=False).select("org_id", "code")


_JOB = with_ctes("", ("tags", "manual_long", "records", "taxonomy")).rstrip() + f""",
chosen AS (SELECT org_id, code FROM tags WHERE org_id NOT IN (SELECT org_id FROM manual_long) UNION SELECT org_id, code FROM manual_long),
wide AS ({GROUPED.format('chosen')})
SELECT w.org_id, w.code, r.name, x.tag AS code_name FROM wide w LEFT JOIN records r ON w.org_id = r.org_id LEFT JOIN taxonomy x ON w.code = x.code"""


@query("job_tag_rules", _JOB)
def job_tag_rules(spark, sf):
    manual = joins.first_label(stacked(spark, sf), "tags")
    out = jobs.job_tag_rules(records(spark, sf), RULES, manual, include_groups=True, taxonomy=taxonomy(spark))
    return out.select("org_id", "code", "name", "code_name")


_GOLD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("reg_number", "name", "activities", "objects", "tags", "class_code")]
    + [T.StructField("income", T.DoubleType())]
)


@query("job_gold_sample", """SELECT 'GB-CHC-' || d.doc_id AS org_id, CAST(d.doc_id AS VARCHAR) AS reg_number, source AS name, replace(text, chr(10), ' ') AS activities, '' AS objects,
  lang || ';' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS tags, NULL::VARCHAR AS class_code, CAST(n_chars AS DOUBLE) AS income
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def job_gold_sample(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    body = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("reg_number"), F.col("source").alias("name"), F.col("text").alias("activities"),
            F.array("lang", F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("tags"),
            F.lit("not a list").alias("class_code"), F.col("n_chars").cast("double").alias("income"),
        )
    )
    return jobs.job_gold_sample(d.select(F.col("doc_id").alias("id"), body.alias("fields")), _GOLD)


_RAW_TAX = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("code", "tag", "full_name", "related", "include", "not_used")]
)


@query("job_taxonomy", """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS tag, p_brand || ';' || p_type AS related, '\\b(' || p_name || ')\\b' AS include
  FROM part WHERE p_type <> 'ECONOMY'""")
def job_taxonomy(spark, sf):
    p = table(spark, sf, "part")
    body = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("tag"), F.col("p_name").alias("full_name"),
            F.array("p_brand", "p_type").alias("related"), F.concat(F.lit(r"\b("), "p_name", F.lit(r")\b")).alias("include"),
            F.when(F.col("p_type") == "ECONOMY", "merged").alias("not_used"),
        )
    )
    raw = p.select(F.col("p_partkey").alias("id"), body.alias("fields"))
    return jobs.job_taxonomy(raw, _RAW_TAX, ["code", "tag", "related", "include"])


@query("job_report", _category_sql())
def job_report(spark, sf):
    out = jobs.job_report(records(spark, sf), group_tags(spark, sf), taxonomy(spark))
    return rows6(out["distributions"], "percentage")


_MEMBERS = """(SELECT DISTINCT x.code, t.org_id FROM group_tags t JOIN taxonomy x ON starts_with(t.code, x.code)) m JOIN records r USING (org_id)"""


@query("job_report_largest", f"""SELECT code, org_id, income FROM {_MEMBERS}
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY income DESC NULLS LAST, org_id) <= 10""", ("group_tags", "taxonomy", "records"))
def job_report_largest(spark, sf):
    return jobs.job_report(records(spark, sf), group_tags(spark, sf), taxonomy(spark))["largest"].select("code", "org_id", "income")


@query("job_report_random", f"""SELECT code, org_id FROM {_MEMBERS} QUALIFY count(*) OVER (PARTITION BY code) > 10
  AND row_number() OVER (PARTITION BY code ORDER BY md5('42:' || org_id)) <= 10""", ("group_tags", "taxonomy", "records"))
def job_report_random(spark, sf):
    return jobs.job_report(records(spark, sf), group_tags(spark, sf), taxonomy(spark))["random"].select("code", "org_id")


def _deliveries(spark, sf):
    """An older delivery of the records: without some, some with another text, some that are gone since."""
    new = corpus(spark, sf).select("org_id", "corpus")
    n = F.regexp_extract("org_id", r"(\d+)$", 1).cast("long")
    old = new.where(n % 10 != 0).withColumn("corpus", F.when(n % 7 == 1, "the licence").otherwise(F.col("corpus")))
    gone = new.where(n % 13 == 0).withColumn("org_id", F.concat("org_id", F.lit("-old")))
    return old.unionByName(gone), new


@query("refresh_tags", "SELECT org_id, code FROM tags", ("tags",))
def refresh_tags(spark, sf):
    """Tags of a store filled from the older delivery and refreshed by the newer one."""
    store = refresh.TagStore(spark, scratch(spark) + "/store")
    for delivery in _deliveries(spark, sf):
        store.refresh(delivery, lambda df: rules.tag_by_rules(df, RULES))
    return store.tags()


@query("refresh_changes", """SELECT change, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 7 = 1 AND corpus <> 'the licence' THEN 'changed' END AS change FROM (SELECT *, CAST(substr(org_id, 8) AS BIGINT) AS doc_id FROM corpus)
  UNION ALL SELECT 'removed' FROM corpus WHERE CAST(substr(org_id, 8) AS BIGINT) % 13 = 0) WHERE change IS NOT NULL GROUP BY change""", ("corpus",))
def refresh_changes(spark, sf):
    old, new = (refresh.record_digests(x) for x in _deliveries(spark, sf))
    return refresh.snapshot_diff(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"))

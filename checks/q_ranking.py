"""First rows, top rows, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import class_scores, group_tags, query, records, rows6, stacked, table, tags
from checks.q_functions import _band_sql
from tagspark import fixed
from tagspark.functions.codes import band
from tagspark.operators import ranking


@query("dedupe_first", """SELECT org_id, file_ord, row_ord FROM stacked
  QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY file_ord, row_ord) = 1""", ("stacked",))
def dedupe_first(spark, sf):
    return ranking.dedupe_first(stacked(spark, sf), ["org_id"]).select("org_id", "file_ord", "row_ord")


@query("distinct_sorted", "SELECT DISTINCT user_id, event_type FROM events ORDER BY user_id, event_type")
def distinct_sorted(spark, sf):
    return ranking.distinct_sorted(table(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("top_n_by_income", "SELECT org_id, income FROM records WHERE active ORDER BY income DESC, org_id LIMIT 200", ("records",))
def top_n_by_income(spark, sf):
    return ranking.top_n_by_income(records(spark, sf).where("active").select("org_id", "income"), 200)


@query("top_n_per_code", """SELECT code, org_id, income FROM group_tags JOIN records USING (org_id)
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY income DESC NULLS LAST, org_id) <= 10""", ("group_tags", "records"))
def top_n_per_code(spark, sf):
    rows = group_tags(spark, sf).join(records(spark, sf).select("org_id", "income"), "org_id")
    return ranking.top_n_per_code(rows)


@query("sample_n_per_code", """SELECT org_id, code FROM tags QUALIFY count(*) OVER (PARTITION BY code) > 10
  AND row_number() OVER (PARTITION BY code ORDER BY md5('42:' || org_id)) <= 10""", ("tags",))
def sample_n_per_code(spark, sf):
    return ranking.sample_n_per_code(tags(spark, sf))


_BAND = _band_sql("income", fixed.SAMPLE_EDGES, fixed.SAMPLE_LABELS)


@query("sample_n_per_stratum", f"""SELECT org_id, band, source FROM (SELECT org_id, source, {_BAND} AS band FROM records) WHERE band IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY band, source ORDER BY md5('7:' || org_id)) <= 20""", ("records",))
def sample_n_per_stratum(spark, sf):
    r = records(spark, sf).withColumn("band", band(F.col("income"), fixed.SAMPLE_EDGES, fixed.SAMPLE_LABELS))
    return ranking.sample_n_per_stratum(r.select("org_id", "band", "source"), ["band", "source"], 20, 7)


@query("sample_n", "SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey) LIMIT 5000")
def sample_n(spark, sf):
    return ranking.sample_n(table(spark, sf, "orders").select("o_orderkey"), 5000, 5, "o_orderkey")


@query("sample_n_few", "SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey) LIMIT 700")
def sample_n_few(spark, sf):
    return ranking.sample_n(table(spark, sf, "orders").select("o_orderkey"), 700, 5, "o_orderkey")


@query("sample_n_repeats", """SELECT count(*) AS n FROM (SELECT 1 FROM orders UNION ALL SELECT 2 FROM orders LIMIT 1501)""")
def sample_n_repeats(spark, sf):
    """Every id twice, and most rows without one: still exactly the number asked for."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("id"), "o_totalprice")
    return ranking.sample_n(o.unionByName(o), 1501, 5, "id").agg(F.count("*").alias("n"))


@query("top_n_per_code_many", """SELECT code, org_id, income FROM group_tags JOIN records USING (org_id)
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY income DESC NULLS LAST, org_id) <= 2000""", ("group_tags", "records"))
def top_n_per_code_many(spark, sf):
    rows = group_tags(spark, sf).join(records(spark, sf).select("org_id", "income"), "org_id")
    return ranking.top_n_per_code(rows, 2000)


@query("argmax_class", "SELECT org_id, code AS class_code, round(score, 6) AS class_code_probability FROM class_ranks WHERE rn = 1", ("class_ranks",))
def argmax_class(spark, sf):
    return rows6(ranking.argmax_class(class_scores(spark, sf)), "class_code_probability")


@query("top3_classes", """SELECT a.org_id, a.code AS code_1, round(a.score, 6) AS prob_1, b.code AS code_2, round(b.score, 6) AS prob_2,
  c.code AS code_3, round(c.score, 6) AS prob_3 FROM class_ranks a JOIN class_ranks b ON a.org_id = b.org_id AND b.rn = 2
  JOIN class_ranks c ON a.org_id = c.org_id AND c.rn = 3 WHERE a.rn = 1""", ("class_ranks",))
def top3_classes(spark, sf):
    return rows6(ranking.top3_classes(class_scores(spark, sf)), "prob_1", "prob_2", "prob_3")


_SUMMARY = """(SELECT p_brand AS grid_approach, p_type, p_size, round(avg(p_retailprice), 4) AS f1_mean FROM part GROUP BY ALL)"""


def _summary(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("grid_approach"), "p_type", "p_size")
    return p.agg(F.round(F.avg("p_retailprice"), 4).alias("f1_mean"))


@query("rank_settings", f"""SELECT *, row_number() OVER (PARTITION BY grid_approach ORDER BY f1_mean DESC, p_type, p_size)::INTEGER AS rank FROM {_SUMMARY}""")
def rank_settings(spark, sf):
    return ranking.rank_settings(_summary(spark, sf), "f1_mean", tie=["p_type", "p_size"])


@query("show_top", f"""SELECT * FROM (SELECT * FROM {_SUMMARY} QUALIFY row_number() OVER (PARTITION BY p_type, p_size ORDER BY f1_mean DESC, grid_approach) = 1)
  ORDER BY f1_mean DESC, grid_approach, p_type, p_size LIMIT 25""")
def show_top(spark, sf):
    order = [F.desc("f1_mean"), "grid_approach"]
    return ranking.show_top(_summary(spark, sf), 25, ["p_type", "p_size"], order=[*order, "p_type", "p_size"])


@query("sort_output", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_output(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.sort_output(o, [F.desc("o_totalprice"), "o_orderkey"])


@query("split_holdout", """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) <= ceil(count(*) OVER () * 0.2) AS test FROM orders""")
def split_holdout(spark, sf):
    dev, test = ranking.split_holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42)
    return dev.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@query("split_stratified", """SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('9:' || o_orderkey)) <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.3) AS test FROM orders""")
def split_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    dev, test = ranking.split_stratified(o, "o_orderkey", "o_orderpriority", 0.3, 9)
    return dev.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@query("two_band_sample", """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'high' ELSE 'low' END AS sample_band FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_totalprice >= 400000 ORDER BY md5('3:' || o_orderkey)) <= CASE WHEN o_totalprice >= 400000 THEN 1328 ELSE 2875 END""")
def two_band_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.two_band_sample(o, "o_totalprice", 400000, 2875, 1328, 3, "o_orderkey").drop("o_totalprice")



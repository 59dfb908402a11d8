"""Sources and sinks: tables are written in the foreign form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import eval_rows, query, records, scratch, table
from tagspark import schema
from tagspark.operators import ranking
from tagspark.sources import config_io, readers, sinks

_CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
_ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderdate", T.DateType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@query("scan_tsv", """SELECT event_id, event_type || chr(9) || props AS note, CAST(ts AS DATE) AS day FROM events""")
def scan_tsv(spark, sf):
    e = table(spark, sf, "events")
    # Tabs and backslashes inside a cell are written with a leading backslash.
    cell = F.regexp_replace(F.concat_ws("\t", "event_type", "props"), r"([\t\\])", r"\\$1")
    lines = F.concat_ws("\t", F.col("event_id").cast("string"), cell, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    path = scratch(spark) + "/tsv"
    e.select(lines.alias("value")).write.text(path)
    kinds = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("note", T.StringType()),
            T.StructField("day", T.DateType()),
        ]
    )
    return readers.scan_tsv(spark, path, kinds, ["day"])


@query("scan_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, sf):
    path = scratch(spark) + "/csv"
    sinks.sink_csv(table(spark, sf, "customer"), path)
    return readers.scan_csv(spark, path, _CUSTOMER)


@query("scan_multi", """SELECT *, row_number() OVER (PARTITION BY file_ord ORDER BY id) AS place FROM
  (SELECT item_id AS id, text, CAST(0 AS INTEGER) AS file_ord FROM benchmark UNION ALL SELECT doc_id, text, 1 FROM documents)""")
def scan_multi(spark, sf):
    """Texts keep their line breaks, and rows the order in which they stand in their folder of files."""
    base = scratch(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, key, path in (("benchmark", "item_id", "/a"), ("documents", "doc_id", "/b")):
        rows = table(spark, sf, name).select(F.col(key).alias("id"), "text").repartitionByRange(n, "id").sortWithinPartitions("id")
        rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(base + path)
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    out = readers.scan_multi(spark, [base + "/a", base + "/b"], kinds, multi_line=True)
    return ranking.place_within(out, "file_ord", ["row_ord"], "place").drop("row_ord")


@query("scan_dayfirst", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, o_totalprice FROM orders""")
def scan_dayfirst(spark, sf):
    path = scratch(spark) + "/dayfirst"
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy"))
    sinks.sink_csv(o, path)
    return readers.scan_dayfirst(spark, path, _ORDERS, ["o_orderdate"])


_UPPER = bytes(range(128, 256)).decode("cp858")
_KEEP = "[^!-~ " + _UPPER + "]"


@query("scan_encoded", f"""SELECT conv_id, turn, trim(regexp_replace(text, '{_KEEP}', ' ', 'g')) AS text FROM conversations""")
def scan_encoded(spark, sf):
    # The writer takes few charsets: put each byte's Latin-1 character instead.
    text = F.trim(F.regexp_replace("text", _KEEP, " "))
    latin = bytes(range(128, 256)).decode("latin-1")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.translate(text, _UPPER, latin).alias("text"))
    path = scratch(spark) + "/encoded"
    c.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    kinds = T.StructType(
        [
            T.StructField("conv_id", T.LongType()),
            T.StructField("turn", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
    return readers.scan_encoded(spark, path, kinds).withColumn("text", F.trim("text"))


@query("records_to_table", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing,
  user_id || ';' || event_type AS pair, NULL::VARCHAR AS not_a_list FROM events""")
def records_to_table(spark, sf):
    e = table(spark, sf, "events")
    body = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.array(F.col("user_id").cast("string"), "event_type").alias("pair"),
            F.col("event_type").alias("not_a_list"),
        )
    )
    kinds = T.StructType(
        [
            T.StructField("k", T.LongType()),
            T.StructField("missing", T.StringType()),
            T.StructField("pair", T.StringType()),
            T.StructField("not_a_list", T.StringType()),
        ]
    )
    rows = e.select("event_id", body.alias("fields"))
    return readers.records_to_table(rows, kinds, ["pair", "not_a_list"], id_cols=["event_id"])


@query("sink_csv", """SELECT c_custkey, c_name, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal FROM customer""")
def sink_csv(spark, sf):
    path = scratch(spark) + "/sink"
    sinks.sink_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, ["c_acctbal"])
    return spark.read.schema("c_custkey long, c_name string, c_acctbal long").option("header", True).csv(path)


@query("sink_split_active", """SELECT org_id, CAST(income AS BIGINT) AS income, active FROM records""", ("records",))
def sink_split_active(spark, sf):
    path = scratch(spark) + "/split"
    sinks.sink_split_active(records(spark, sf).select("org_id", "income", "active"), path, whole_number_cols=["income"])
    kinds = "org_id string, income long"
    parts = [
        spark.read.schema(kinds).option("header", True).csv(f"{path}/active={flag}").withColumn("active", F.lit(flag == "true"))
        for flag in ("true", "false")
    ]
    return parts[0].unionByName(parts[1])


_PREDICTIONS = """SELECT g.org_id, coalesce((SELECT string_agg(code, ';' ORDER BY code) FROM truth t WHERE t.org_id = g.org_id), '') AS true_codes,
  coalesce((SELECT string_agg(code, ';' ORDER BY code) FROM pred p WHERE p.org_id = g.org_id), '') AS predicted_codes,
  'regex_rules' AS prediction_source FROM gold g"""


@query("sink_predictions", _PREDICTIONS, ("gold", "truth", "pred"))
def sink_predictions(spark, sf):
    path = scratch(spark) + "/predictions"
    sinks.sink_predictions(eval_rows(spark, sf).withColumn("approach", F.lit("regex")), path, ["approach"])
    kinds = "org_id string, true_codes string, predicted_codes string, prediction_source string"
    back = spark.read.schema(kinds).option("header", True).csv(f"{path}/approach=regex")
    return back.na.fill("", ["true_codes", "predicted_codes"])


@query("config_io", """SELECT CAST(42 AS INTEGER) AS seed, 0.2::DOUBLE AS test_size, count(*) AS labelled_rows,
  count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS dev_rows, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_rows FROM labels""")
def save_split_info(spark, sf):
    from tagspark.plans import workflow

    path = scratch(spark) + "/split_info"
    gold = table(spark, sf, "labels").withColumn("org_id", F.col("doc_id").cast("string"))
    _, _, info = workflow.make_split(gold, 42, 0.2)
    config_io.save(spark, info, schema.SPLIT_INFO, path)
    loaded = config_io.load(spark, schema.SPLIT_INFO, path)
    assert loaded == info
    return spark.read.schema(schema.SPLIT_INFO).json(path)


@query("sink_grid", """SELECT 'state' AS part, source AS grid_approach, CAST(n_chars AS BIGINT) AS rows FROM documents
  UNION ALL SELECT 'summary', source, count(*) FROM documents GROUP BY source""")
def sink_grid(spark, sf):
    path = scratch(spark) + "/grid"
    d = table(spark, sf, "documents")
    per_state = d.select(F.col("source").alias("grid_approach"), F.col("n_chars").alias("rows"))
    summary = per_state.groupBy("grid_approach").agg(F.count("*").alias("rows"))
    sinks.sink_grid(per_state, summary, path)
    parts = [spark.read.parquet(f"{path}/{x}").select(F.lit(name).alias("part"), "grid_approach", "rows") for name, x in (("state", "per_state"), ("summary", "summary"))]
    return parts[0].unionByName(parts[1])


@query("best_settings", """SELECT v.*, l.n FROM (VALUES ('hybrid_logistic', 'name,activities', true, 0.3::DOUBLE, 0.05::DOUBLE, 'logistic', NULL),
  ('ovr_sgd', 'name', false, 0.4::DOUBLE, NULL, 'sgd', 'log_loss')) AS v(approach, fields_key, clean_text, threshold, hybrid_conf, model_family, sgd_loss)
  CROSS JOIN (SELECT count(*) AS n FROM labels) l""")
def best_settings(spark, sf):
    """Chosen settings stored, loaded as settings, stored again."""
    from tagspark.operators.models import Settings
    from tagspark.plans import grid

    path = scratch(spark)
    best = {
        "hybrid_logistic": Settings(approach="hybrid_logistic", threshold=0.3, hybrid_conf=0.05, hybrid_rule="label_conf_gated_regex"),
        "ovr_sgd": Settings(approach="ovr_sgd", fields=("name",), clean_text=False, model_family="sgd", sgd_loss="log_loss", sgd_alpha=1e-4, threshold=0.4),
    }
    grid.save_best(spark, best, path + "/one")
    loaded = grid.load_best(spark, path + "/one")
    assert loaded == best
    grid.save_best(spark, loaded, path + "/two")
    back = spark.read.schema(schema.BEST_SETTINGS).json(path + "/two")
    n = table(spark, sf, "labels").agg(F.count("*").alias("n"))
    return back.select("approach", "fields_key", "clean_text", "threshold", "hybrid_conf", "model_family", "sgd_loss").withColumn("n", n.scalar())

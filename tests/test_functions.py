import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspark import fixed
from tagspark.functions import codes, text
from tagspark.operators import ranking, registry
from tagspark.operators.text_ops import lemma_lookup
from tagspark.sources import readers, sinks


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_clean_text_drops_symbols_and_stop_words(spark):
    df = spark.createDataFrame([("The Cats, (Trust) don't\nstop #1 a/b é",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.clean_text(F.col("t"))).collect()]
    # The newline and the apostrophe are deleted, so words around them fuse.
    assert got == ["cats dontstop #1 b", "", None]


def test_stopwords_hold_the_additions():
    words = text.stopwords()
    assert len(words) == len(set(words))
    assert {"the", "wouldn't", "trust", "charity"} <= set(words)


def test_corpus_fills_and_never_nulls(spark):
    df = spark.createDataFrame(
        [("n", None, "obj"), (None, "act", "obj"), (None, None, None)], "name string, activities string, objects string"
    )
    got = [r.corpus for r in text.text_corpus(df).collect()]
    assert got == ["n obj", " act", " "]
    assert [r.corpus_length for r in text.corpus_length(df).collect()] == [5, 4, 1]


def test_tokens_and_ngrams(spark):
    row = one(
        spark,
        t=text.word_tokens(F.lit("A big été, x_1!")),
        g=text.word_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 3),
        short=text.word_ngrams(F.array(F.lit("a")), 2),
        ch=text.char_wb_ngrams(F.lit("ab c"), 5),
    )
    assert row.t == ["big", "été", "x_1"]
    assert row.g == ["a", "b", "c", "a b", "b c", "a b c"]
    assert row.short == ["a"]
    assert row.ch == [" ab", "ab ", " ab ", " c "]


def test_ids_and_addresses(spark):
    df = spark.createDataFrame([("NIC100",), ("SC12",), ("SC1234567",), ("22",)], "r string")
    got = [r[0] for r in df.select(text.regnumber_to_orgid(F.col("r"))).collect()]
    assert got == ["GB-NIC-100", "GB-SC-SC000012", "GB-SC-SC1234567", "GB-CHC-22"]
    row = one(spark, a=text.postcode_from_address(F.lit("a, b, BT1")), b=text.postcode_from_address(F.lit(None).cast("string")))
    assert (row.a, row.b) == ("BT1", "")


def test_code_sets(spark):
    row = one(
        spark,
        s=codes.split_codes(F.lit(" A; B;;")),
        n=codes.split_codes(F.lit(None).cast("string")),
        j=codes.join_codes(F.array(F.lit("b"), F.lit("a"), F.lit("b"))),
        u=codes.union_codes(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))),
        g=codes.with_groups(F.array(F.lit("HE201"), F.lit("HE"), F.lit("AB101"))),
    )
    assert (row.s, row.n, row.j, row.u) == (["A", "B"], [], "a;b", ["a", "b", "c"])
    assert row.g == ["AB", "AB101", "HE", "HE200", "HE201"]


def test_bands_are_right_closed(spark):
    values = [-2.0, -1.0, -0.5, 10_000.0, 10_000.5, 1e7, 1e9, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    band = codes.income_band(F.col("v"), fixed.INCOME_EDGES, fixed.INCOME_LABELS)
    got = [r[0] for r in df.select(band).collect()]
    low = "Under £10k"
    assert got == [None, None, low, low, "£10k - £100k", "£1m - £10m", "Over £10m", None, None]


def test_rounding_is_half_even(spark):
    row = one(spark, a=codes.round_score(F.lit(0.125), 2), b=codes.round_score(F.lit(0.375), 2))
    assert (row.a, row.b) == (0.12, 0.38)


def test_active_rules_treat_null(spark):
    df = spark.createDataFrame([("Removed",), ("Registered",), (None,)], "s string")
    s = F.col("s")
    got = df.select(
        registry.active_flag("equals", s, "Registered"), registry.active_flag("is_null", s),
        registry.active_flag("differs", s, "Removed"),
    ).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, False, True), (False, True, True)]


def test_lemma_lookup_keeps_order(spark):
    df = spark.createDataFrame([("x", ["cats", "are", "cats"]), ("y", [])], "org_id string, t array<string>")
    lex = spark.createDataFrame([("cats", "cat")], "surface string, lemma string")
    got = {r.org_id: r.lemmas for r in lemma_lookup(df, "t", lex).collect()}
    assert got == {"x": ["cat", "are", "cat"], "y": []}


KINDS = T.StructType(
    [T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())]
)
DAY = datetime.date(2020, 2, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tsv_escapes_and_bad_dates(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text('id\tname\tday\n1\tA\\\tB\t2020-02-01T00:00:00\n2\tq"x\\\\\t\n3\tNULL\tbad\n')
    assert rows(readers.scan_tsv(spark, str(path), KINDS)) == [(1, "A\tB", DAY), (2, 'q"x\\', None), (3, None, None)]


def test_csv_by_name_with_bom(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿day,id\n2020-02-01,1\n,x\n', encoding="utf-8")
    got = readers.scan_csv(spark, str(path), KINDS).collect()
    assert [tuple(r) for r in got] == [(1, None, DAY), (None, None, None)]


def test_dayfirst_and_code_page(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('id,name,day\n1,Café €,1/2/2020\n2,"x, ""y""",01/02/2020\n'.encode("cp858"))
    got = rows(readers.scan_encoded(spark, str(path), KINDS, date_cols=["day"]))
    assert got == [(1, "Café €", DAY), (2, 'x, "y"', DAY)]


def test_files_stack_in_order(spark, tmp_path):
    for name, first in (("a", 1), ("b", 5)):
        (tmp_path / f"{name}.csv").write_text(f"id,name\n{first},x\n{first + 1},y\n")
    df = readers.scan_multi(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], KINDS)
    got = [r.id for r in df.orderBy("file_ord", "row_ord").collect()]
    assert got == [1, 2, 5, 6]


def test_a_folder_of_files_is_read_in_order_by_several_tasks(spark, tmp_path):
    for i in range(3):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"part-{i}.csv").write_text("id,name\n" + "".join(f'{10 * i + j},"x\ny"\n' for j in range(1 + 4 * (i == 0))))
    (tmp_path / "b.csv").write_text('id,name\n7,"z"\n')
    df = readers.scan_multi(spark, [str(tmp_path / "a"), str(tmp_path / "b.csv")], KINDS, multi_line=True)
    got = ranking.place_within(df, "file_ord", ["row_ord"], "place")
    assert sorted((r.file_ord, r.place, r.id, r.name) for r in got.collect()) == [
        *((0, i + 1, x, "x\ny") for i, x in enumerate([0, 1, 2, 3, 4, 10, 20])), (1, 1, 7, "z")
    ]


def test_places_of_a_large_group_lie_over_many_tasks(spark):
    rows = spark.range(1000).selectExpr("if(id < 990, 'a', if(id < 995, null, 'b')) AS g", "id")
    got = ranking.place_within(rows.repartition(4), "g", ["id"], "place")
    start = {"a": 0, None: 990, "b": 995}
    assert all(r.place == r.id - start[r.g] + 1 for r in got.collect()) and got.count() == 1000
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_records_to_table(spark):
    raw = spark.createDataFrame([("1", '{"a":"x","l":["p","q"]}'), ("2", '{"l":"no list"}')], "id string, fields string")
    kinds = T.StructType([T.StructField("a", T.StringType()), T.StructField("l", T.StringType())])
    got = {r.id: (r.a, r.l) for r in readers.records_to_table(raw, kinds, ["l"]).collect()}
    assert got == {"1": ("x", "p;q"), "2": (None, None)}


def test_csv_sink_cuts_money(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.9, True), ("b", -1.9, None)], "org_id string, income double, active boolean")
    sinks.sink_csv(df, str(tmp_path / "out"), ["income"])
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(r.income for r in back.collect()) == ["-1", "1"]
    sinks.sink_split_active(df, str(tmp_path / "split"))
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"active=true", "active=false"}

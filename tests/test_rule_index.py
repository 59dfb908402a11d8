"""Rules by the index equal rules tried one by one, whatever their form."""

import re

import pytest
from pyspark.sql import functions as F

from tagspark.functions.patterns import RUN_EDGES, Piece, required_pieces
from tagspark.operators import rule_index, rules


def test_pieces():
    whole = lambda x: Piece(x, True, True)
    assert required_pieces(r"\b(the|and)\b") == [whole("and"), whole("the")]
    assert required_pieces(r"(^|[^\p{L}\p{N}_])licen[cs]e") == [Piece("licen", True, False)]
    assert required_pieces(r"educat(ion|or)s?") == [Piece("educat", False, False)]
    assert required_pieces(r"\bhealth ?care\b") == [Piece("health", True, False)]
    assert required_pieces(r"health care\b") == [whole("care")]
    assert required_pieces(r"ab+cde|x{2}yyz") == [Piece("cde", False, False), Piece("yyz", False, False)]
    for odd in (r"[a-z]+@", r"a|bcd", r"(foo|)", r"(?x)foo", r"\Qfoo\E", r"\x41bcd", r"(foo", r"(?!foo)", r"(foo)?", r"", r"σοφία|ßßß"):
        assert required_pieces(odd) is None, odd


@pytest.mark.parametrize("pattern", [r"\bcat\w*", r"(un|re)happ(y|ily)", r"fo{2,}d|b.d", r"colou?r", r"[^a]dog", r"(?:wind){2}", r"well[- ]being", r"caf(é|e)s"])
def test_a_match_holds_a_piece(pattern):
    texts = ["cats", "a Cat!", "unhappy", "REHAPPILY", "foood", "bad", "color colour", "xdog", "windwind", "well-being", "CAFÉS cafes", "catalogue", "well being"]
    pieces = required_pieces(pattern)
    for text in texts:
        if pieces and re.search(pattern, text, re.I):
            words = [x.lower() for x in re.findall(r"[^\W\d_]+", text)]
            assert any((not p.begins or w.startswith(p.letters)) and (not p.ends or w.endswith(p.letters)) and p.letters in w for w in words for p in pieces), text


LISTED = [
    rules.Rule("A1", r"\b(the|and)\b", r"\bnot\b"), rules.Rule("A1", "zebra"), rules.Rule("B2", r"(^|[^\p{L}\p{N}_])edu"), rules.Rule("C3", r"\w+@\w+"),
    rules.Rule("D4", r"stra(ß|ss)e"), rules.Rule("E5", r"kelvin"), rules.Rule("F6", r"λόγος"), rules.Rule("G7", r"\bis\b", "island"), rules.Rule("H8", r"ing\b"),
    rules.Rule("I9", r"\b()\b"), rules.Rule("J1", None), rules.Rule("K2", r"(?i)ÉCOLE"), rules.Rule("L3", r"qqq"), rules.Rule("M4", "e.e", ""), rules.Rule("N5", r"İstanbul"),
    rules.Rule("A1", r"\b(the|and)\b", r"\bnot\b"),
]
TEXTS = [
    "The Zebra", "and not", "re-education, EDU", "mail me@here", "STRASSE straße STRAẞE", "Kelvin KELVIN", "ΛΌΓΟΣ λόγος", "This is an island", "is it", "Singing thing-ness",
    "école ECOLE École", "", None, "ele", "The Zebra", "istanbul İSTANBUL", "x" * 3000 + " zebra",
]


def test_index_equals_trying_every_rule(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "org_id int, corpus string").repartition(3)
    listed = [r for r in LISTED if r.include]
    want = sorted(map(tuple, rules.tag_by_rules(texts, listed).collect()))
    assert sorted(map(tuple, rules.tag_by_rules(texts, rules.rule_table(spark, LISTED)).collect())) == want
    assert {"A1", "B2", "C3", "E5", "H8", "K2", "M4"} <= {c for _, c in want}
    groups = sorted(map(tuple, rules.tag_by_rules(texts, rules.rule_table(spark, LISTED), include_groups=True).collect()))
    assert groups == sorted(map(tuple, rules.tag_by_rules(texts, listed, include_groups=True).collect()))


def test_blocks_empty_tables_and_own_columns(spark, monkeypatch):
    texts = spark.createDataFrame([(None, t, "own") for t in TEXTS], "org_id string, corpus string, codes string")
    table = rules.rule_table(spark, LISTED)
    whole = sorted(map(str, rules.tag_sets(texts, table, out="found").collect()))
    assert len(whole) == len(TEXTS) and all("codes='own'" in x for x in whole)
    monkeypatch.setattr(rule_index, "BLOCK_WORDS", 3)
    assert sorted(map(str, rules.tag_sets(texts, table, out="found").collect())) == whole
    assert rules.tag_by_rules(texts.limit(0), table).count() == 0
    assert rules.tag_sets(texts, table.limit(0), out="found").where(F.size("found") > 0).count() == 0


def test_the_plan_does_not_grow_with_the_rules(spark):
    texts = spark.createDataFrame([(1, "word7 or word")], "org_id int, corpus string")

    def plan(n):
        sets = rules.tag_sets(texts, rules.rule_table(spark, [rules.Rule(f"R{i}", rf"\bw{'o' * i}rd") for i in range(n)]))
        return len(sets._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan(5) == plan(400)
    long = rules.tag_by_rules(texts, [rules.Rule(f"R{i:03}", rf"\bw{'o' * i}rd") for i in range(400)])
    assert [tuple(r) for r in long.collect()] == [(1, "R001")]


def test_plain_words_are_settled_without_a_pattern(spark):
    left, right = RUN_EDGES
    made = [
        rules.Rule("A", f"{left}(the|of){right}"), rules.Rule("B", f"{left}kel"), rules.Rule("C", f"ing{right}", "island"), rules.Rule("D", "sti", f"{left}(not){right}"),
        rules.Rule("E", f"{left}(xis){right}", f"{left}(not){right}"), rules.Rule("A", "stra"),
    ]
    texts = ["the_x", "THE x", "\u00e9the of", "\u212aELVIN", "xkelp kel", "R\u0131ng, sing1", "SINGING \u0130sland", "re\u017ft\u0130ng", "not testing", "x\u0130\u017f", "X\u0131S not", "Stra\u00dfe", "", None, "THE x"]
    rows = spark.createDataFrame([(i, t, [t]) for i, t in enumerate(texts)], "org_id int, corpus string, own array<string>").repartition(3)
    index = rule_index.build_index(rows, rules.rule_table(spark, made))
    assert index.n_words == 0 and index.anywhere.isEmpty() and not index.plain.isEmpty()
    got = {r.org_id: (r.own, r.codes) for r in rules.tag_sets(rows, index).collect()}
    want = {r.org_id: (r.own, r.codes) for r in rules.tag_sets(rows, made).collect()}
    assert got == want and sorted({c for _, codes in want.values() for c in codes}) == list("ABCDE")
    mixed = [*made, rules.Rule("F", r"t.e"), rules.Rule("G", r"\bkel\w*", f"{left}(not){right}")]
    assert sorted(map(str, rules.tag_sets(rows, rules.rule_table(spark, mixed)).collect())) == sorted(map(str, rules.tag_sets(rows, mixed).collect()))

"""Terms that lie by record: nothing but lists of tokens and each part's own vocabulary travels."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagspark.operators import features, joins, models, term_lists
from tagspark.operators.text_ops import lemma_lookup

TEXTS = [("1", "a a b c"), ("2", "a b"), ("2", "b d"), (None, "a d"), (None, "d"), ("3", ""), ("4", None), ("5", "e a c c")]


def lists(spark):
    return spark.createDataFrame(TEXTS, "org_id string, text string").select("org_id", F.filter(F.split("text", " "), lambda w: w != "").alias("t"))


def by_hand():
    tf = Counter((i, w) for i, t in TEXTS for w in (t or "").split())
    df = Counter(w for _, w in tf)
    return tf, df


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_counts_of_repeated_and_missing_ids(spark):
    tf, df = by_hand()
    got = {(r.org_id, r.term): (r.tf, r.df) for r in features.term_counts(lists(spark), "t", 2).collect()}
    assert got == {k: (n, df[k[1]]) for k, n in tf.items() if df[k[1]] >= 2}


@pytest.mark.parametrize("keep", [False, True])
def test_weights_with_and_without_parts(spark, keep):
    tf, df = by_hand()
    n = spark.createDataFrame([(6,)], "n long")
    got = features.tfidf_l2(features.term_counts(lists(spark), "t", 1, keep_part=keep), n)
    raw = {k: v * (math.log(7 / (1 + df[k[1]])) + 1) for k, v in tf.items()}
    size = Counter()
    for (i, _), x in raw.items():
        size[i] += x * x
    assert {(r.org_id, r.term): r.weight for r in got.collect()} == pytest.approx({k: x / math.sqrt(size[k[0]]) for k, x in raw.items()})


def test_pairs_of_record_and_term_never_travel(spark):
    """Before, they did three times for weights and, once for each class, for naive Bayes."""
    terms = features.term_counts(lists(spark), "t", 1, keep_part=True)
    weights = features.tfidf_l2(terms, spark.createDataFrame([(6,)], "n long"))
    labels = spark.createDataFrame([("1", "X"), ("2", "Y"), ("5", "X")], "org_id string, label string")
    bayes = features.naive_bayes_sql(terms.drop("df"), labels, terms.drop("df"))
    for made in (weights, bayes):
        dealt = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange (?:hashpartitioning|RoundRobinPartitioning)\(([^)]*)\)", plan(made))]
        assert dealt and not [x for x in dealt if "org_id" in x or "join_key" in x]


def test_part_join_is_an_inner_join(spark):
    facts = joins.in_parts(spark.createDataFrame([("1", "x", 1), ("1", "y", 2), (None, "x", 3), ("2", "z", 4), ("2", None, 5)], "org_id string, k string, v int"))
    dim = spark.createDataFrame([("x", 10), ("z", 20), ("w", 30)], "k string, d int")
    got = joins.part_join(facts, dim, "k", ["d"])
    assert sorted((r.v, r.d) for r in got.collect()) == [(1, 10), (3, 10), (4, 20)]


def test_two_step_counting_of_tables_without_parts(spark):
    terms = features.term_counts(lists(spark), "t", 1)
    labels = spark.createDataFrame([("1", "A1"), ("2", "B1"), ("5", "A2")], "org_id string, class_code string")
    plain = {tuple(r) for r in models.two_step_counting(terms.select("org_id", "term", "tf"), labels, terms.select("org_id", "term", "tf")).collect()}
    laid = features.term_counts(lists(spark), "t", 1, keep_part=True).drop("df")
    assert plain == {tuple(r) for r in models.two_step_counting(laid, labels, laid).collect()}
    assert {r[0] for r in plain} == {"1", "2", "5"}


def test_lemmas_are_looked_up_where_the_record_lies(spark):
    """Before, the lexicon was counted and broadcast, and one row per token travelled by record."""
    lexicon = spark.createDataFrame([("a", "z"), ("a", "y"), ("c", "k"), ("none", "n")], "surface string, lemma string")
    made = lemma_lookup(lists(spark), "t", lexicon)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(made))
    assert dealt and not [x for x in dealt if "org_id" in x] and "Broadcast" not in plan(made)
    got = {r.org_id: r.lemmas for r in made.collect()}
    # rows of one id come together by place
    assert got == {"1": ["y", "y", "b", "k"], "2": ["b", "y", "b", "d"], None: ["d", "y", "d"], "3": [], "4": [], "5": ["e", "y", "k", "k"]}


def test_lists_of_terms_hold_what_rows_hold(spark):
    tf, df = by_hand()
    made = term_lists.term_lists(lists(spark), "t", 2)
    got = {(r.org_id, t.term): (t.tf, t.df) for r in made.collect() for t in r.terms}
    assert got == {k: (n, df[k[1]]) for k, n in tf.items() if df[k[1]] >= 2}
    assert made.count() == len({i for i, w in tf if df[w] >= 2})
    gaps = spark.createDataFrame([("1", ["a", None, "a"]), (None, [None]), ("2", []), ("3", None)], "org_id string, t array<string>")
    assert [(r.org_id, [tuple(t) for t in r.terms]) for r in term_lists.term_lists(gaps, "t", 1).collect()] == [("1", [("a", 2, 1)])]


def test_weights_of_lists_are_scaled_without_a_sort_by_record(spark):
    """Before, scores sorted one row per record and term to scale them, and made the tokens twice."""
    n = spark.createDataFrame([(6,)], "n long")
    weights = term_lists.weights_of(term_lists.term_lists(lists(spark), "t", 1), n)
    rows = features.tfidf_l2(features.term_counts(lists(spark), "t", 1, keep_part=True), n)
    want = {(r.org_id, r.term): r.weight for r in rows.collect()}
    assert {(r.org_id, r.term): r.weight for r in weights.collect()} == pytest.approx(want)
    assert not [x for x in re.findall(r"(?:Sort \[|hashpartitioning\()[^\n]*", plan(weights)) if "org_id" in x or re.search(r"\bid#", x)]


def test_wanted_weights_are_those_of_all_terms(spark):
    """Before, scores were handed the lists of all terms, to keep the few with a coefficient."""
    gaps = spark.createDataFrame([("1", ["a", None, "a", "b"]), ("1", ["c"]), (None, ["a", None]), ("2", []), ("3", None), ("4", ["c", "b"])], "org_id string, t array<string>")
    n, wanted = spark.createDataFrame([(6,)], "n long"), spark.createDataFrame([("a",), ("c",), ("c",), ("none",), (None,)], "term string")
    for rows in (lists(spark), gaps, gaps.limit(0)):
        for least in (1, 2):
            whole = term_lists.weights_of(term_lists.term_lists(rows, "t", least), n)
            want = {(r.org_id, r.term): r.weight for r in whole.collect() if r.term in ("a", "c")}
            made = term_lists.wanted_weights(rows, "t", n, wanted, least)
            got = {(r.org_id, r.term): r.weight for r in made.collect()}
            assert got == want and made.count() == len(want)
    assert "explode" not in plan(term_lists.wanted_weights(gaps, "t", n, wanted)).lower()


def test_a_vocabulary_travels_as_a_row_for_each_part_and_share(spark):
    """Before, each part sent a row for each of its terms, and a window sorted them by term."""
    texts = [(str(i % 90), f"é{i % 7} w{i} w{i + 1}\u0000x " + "long" * (i % 40)) for i in range(3000)]
    rows = spark.createDataFrame(texts, "org_id string, text string").select("org_id", F.filter(F.split("text", " "), lambda w: w != "").alias("t"))
    n, wanted = spark.createDataFrame([(90,)], "n long"), spark.createDataFrame([("é3",), ("w4",), ("longlong",)], "term string")
    _, own, shares = term_lists._asked(rows, "t", "org_id", None)
    assert own.count() <= shares * shares and "Window" not in plan(term_lists.wanted_weights(rows, "t", n, wanted))
    tf = Counter((i, w) for i, t in texts for w in t.split(" ") if w)
    df = Counter(w for _, w in tf)
    for between in (None, " "):
        made = {(r.org_id, t.term): (t.tf, t.df) for r in term_lists.term_lists(rows, "t", 2, between=between).collect() for t in r.terms}
        assert made == {k: (x, df[k[1]]) for k, x in tf.items() if df[k[1]] >= 2}
        weights = {(r.org_id, r.term): r.weight for r in term_lists.wanted_weights(rows, "t", n, wanted, 2, between=between).collect()}
        whole = {(r.org_id, r.term): r.weight for r in term_lists.weights_of(term_lists.term_lists(rows, "t", 2), n).collect()}
        assert weights == pytest.approx({k: w for k, w in whole.items() if k[1] in ("é3", "w4", "longlong")}) and weights


def test_lists_that_travel_as_one_text_keep_gaps(spark):
    gaps = spark.createDataFrame([("1", ["a", None, "a"]), (None, [None]), ("2", []), ("3", None), ("1", ["b"])], "org_id string, t array<string>")
    for least, want in ((1, {("1", "a", 2), ("1", "b", 1)}), (2, set())):
        made = term_lists.term_lists(gaps, "t", least, between=" ").collect()
        assert {(r.org_id, t.term, t.tf) for r in made for t in r.terms} == want
    assert term_lists.term_lists(gaps.limit(0), "t", 1, between=" ").collect() == []


@pytest.mark.parametrize("given", [False, True])
def test_scores_of_lists_and_rows_agree(spark, given):
    n = spark.createDataFrame([(6,)], "n long")
    coefs = spark.createDataFrame([("a", "X", 2.0), ("c", "X", 1.0), ("d", "Y", 3.0)], "term string, code string, coef double")
    records = lists(spark).select("org_id").distinct() if given else None
    rows = features.tfidf_l2(features.term_counts(lists(spark), "t", 1, keep_part=True), n)
    weights = term_lists.weights_of(term_lists.term_lists(lists(spark), "t", 1), n)
    one, two = ({(r.org_id, r.code): r.score for r in features.score_labels(x, coefs, {"X": 0.5, "Y": -1.0}, records=records).collect()} for x in (rows, weights))
    assert one == pytest.approx(two)

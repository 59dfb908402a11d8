"""Rules of whole words need no pattern, and say what the pattern says."""

import pytest
from pyspark.sql import functions as F

from tagspark.operators import rules

EDGES = (r"(^|[^\p{L}\p{N}_])(", r")([^\p{L}\p{N}_]|$)")
WORDS = ["kiss", "gross", "file", "sit", "i", "SIT|k", "s", "ss", *[f"w{c}" for c in "abcdefghijklmnop"]]
TEXTS = [
    "KISS me", "Kiss", "kiſſ", "kiSS_", "_kiss", "kiss2", "2 kiss", "(kiss)", "groß", "GROSS", "groẞ", "ﬁle", "file", "xfile", "sİt", "sıt",
    "si̇t", "sit́", "é sité sit", "Ésit", "İ", "ı", "\U0001d4a6 k", "\U0001d4a6k", "wa,wb;WC\nwd", "wa we", "ß", "ſ", "ﬆ", "", None, "ͅs", "Ⅰ Ⓘ",
]


def listed():
    return [rules.Rule(f"C{i}", EDGES[0] + w + EDGES[1], EDGES[0] + "wb" + EDGES[1] if i % 5 == 0 else None) for i, w in enumerate(WORDS)]


def test_words_say_what_patterns_say(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "org_id string, corpus string")
    got = rules.tag_sets(df, listed())
    plain = df.withColumn("codes", rules.matched_codes(F.col("corpus"), listed()))
    assert {r.corpus: r.codes for r in got.collect()} == {r.corpus: r.codes for r in plain.collect()}


def test_only_excludes_are_tried_as_patterns(spark):
    df = spark.createDataFrame([("1", "wa wb")], "org_id string, corpus string")
    made = rules.tag_sets(df, [r for r in listed() if r.exclude is None] + [rules.Rule("X", EDGES[0] + "wb" + EDGES[1])] * 2)
    assert "rlike" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("pattern", [r"\b(kiss)\b", EDGES[0] + "two words" + EDGES[1], EDGES[0] + "été" + EDGES[1], EDGES[0] + "a[bc]" + EDGES[1], EDGES[0] + "" + EDGES[1]])
def test_other_patterns_stay(pattern):
    assert rules.whole_words(pattern) is None

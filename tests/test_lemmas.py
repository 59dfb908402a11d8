"""Base forms by endings, exceptions and a lexicon, against a plain search."""

import random

import pytest

from tagspark import fixed
from tagspark.operators import text_ops


def plain(word, lexicon, exceptions):
    """Shortest known form, by the fewest rules."""
    def best(forms):
        return min((f for f in forms if f in lexicon), key=lambda f: (len(f), f), default=None)

    if word in exceptions:
        return best([word, *exceptions[word]]) or word
    forms, level = [word], 0
    while forms:
        new = [f[: len(f) - len(old)] + add for f in forms for old, add in fixed.NOUN_ENDINGS if f.endswith(old)]
        found = best(([word] if level == 0 else []) + new)
        if found is not None:
            return found
        forms, level = new, level + 1
    return word


CASES = {
    "dogs": "dog", "buses": "bus", "wolves": "wolf", "boxes": "box", "women": "woman", "cities": "city", "churches": "church", "wishes": "wish", "glass": "glass",
    "geese": "goose", "blorps": "blorps", "dogss": "dog", "men": "man", "s": "s", "leaves": "leaf", "axes": "ax", "better": "better", "data": "data", "us": "us", "é": "é",
}
LEXICON = "dog bus wolf box woman city church wish glass goose man leaf leave axe ax better class".split()
EXCEPTIONS = [("geese", "goose"), ("data", "datum"), ("dogs", "zzz"), ("dogs", "dog"), (None, "x"), ("x", None)]


def test_cases(spark):
    words = spark.createDataFrame([(w,) for w in [*CASES, *CASES, None]], "surface string").repartition(3)
    lexicon = spark.createDataFrame([(w,) for w in [*LEXICON, None, "dog"]], "word string")
    listed = spark.createDataFrame(EXCEPTIONS, "surface string, lemma string")
    assert {r.surface: r.lemma for r in text_ops.base_forms(words, lexicon, listed).collect()} == CASES
    assert text_ops.base_forms(words.limit(0), lexicon, listed).count() == 0
    assert all(r.surface == r.lemma for r in text_ops.base_forms(words, lexicon.limit(0)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    r = random.Random(seed)
    part = lambda: "".join(r.choices(["s", "es", "ses", "i", "e", "m", "en", "a", "ch", "v", "f", "z", "x"], k=r.randrange(1, 6)))
    words, lexicon = {part() for _ in range(300)}, {part() for _ in range(60)}
    listed = {w: [part(), part()] for w in r.sample(sorted(words), 20)}
    got = text_ops.base_forms(
        spark.createDataFrame([(w,) for w in words], "surface string"), spark.createDataFrame([(w,) for w in lexicon], "word string"),
        spark.createDataFrame([(w, x) for w, xs in listed.items() for x in xs], "surface string, lemma string"),
    )
    assert {x.surface: x.lemma for x in got.collect()} == {w: plain(w, lexicon, listed) for w in words}


def test_lists_keep_their_order(spark):
    df = spark.createDataFrame([(1, ["dogs", "and", "dogs", "women"]), (2, []), (3, None), (4, ["s" * 50_000])], "org_id int, tokens array<string>")
    lexicon = spark.createDataFrame([("dog",), ("woman",)], "word string")
    got = {r.org_id: r.lemmas for r in text_ops.lemmatise(df, "tokens", lexicon).collect()}
    assert got[1] == ["dog", "and", "dog", "woman"] and got[2] == [] and got[4] == ["s" * 50_000]

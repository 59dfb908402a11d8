import random

import pytest

from tagspark.llm import langid, quality, toxicity

GOOD = "the river ran past old stone houses while people walked and talked about weather and bread".split()
BAD = "click buy now win free $$$ !!! best cheap offer deal".split()
LABELS = "doc_id long, label int"
DOCS = "doc_id long, text string, score string, n_hits int"


def texts(words, n, seed, k=60):
    r = random.Random(seed)
    return [" ".join(r.choices(words, k=r.randrange(k // 2, k))) for _ in range(n)]


def test_quality_on_held_out_rows(spark, frame):
    rows = [(i, t, 1) for i, t in enumerate(texts(GOOD, 150, 1))] + [(1000 + i, t, 0) for i, t in enumerate(texts(BAD, 150, 2))]
    docs = frame([(i, t, "x", 0) for i, t, _ in rows] + [(5000, None, None, None), (5001, "", "", 0), (5001, "", "", 0), (None, "river " * 9000, "", 0)], DOCS)
    labels = frame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (9999, 0), (3, None)], LABELS)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    right = [(score[i] >= 0.5) == bool(y) for i, _, y in rows if i % 2 == 0]
    assert sum(right) / len(right) > 0.95
    assert quality.fit(docs, frame([(1, 1)], LABELS)) is None and quality.fit(docs, frame([], LABELS)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(frame([], DOCS), None).count() == 0


def test_toxicity_folds_and_spares(spark, frame):
    bad = ["moron", "scumbag"]
    r = random.Random(3)
    rows = []
    for i, t in enumerate(texts(GOOD, 300, 4)):
        w = t.split()
        toxic = i % 3 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad))
        elif i % 3 == 1:  # a harmless phrase around a term
            at = r.randrange(len(w))
            w[at:at] = ["brave", "moron"] if i % 4 == 1 else ["bakers"]
        rows.append((i, " ".join(w), int(toxic)))
    docs = frame([(i, t, "x", 0) for i, t, _ in rows] + [(9001, None, "", 0), (9002, "", "", 0), (9003, "You M0R0N, go", "", 0), (9004, "a мοrоn walked", "", 0), (9005, "SCUMB4G!", "", 0), (9006, "ｓｃｕｍｂａｇ and bread", "", 0), (9007, "the brave moron walked", "", 0), (9008, "oxymoronic bread " * 3000, "", 0)], DOCS)
    model = toxicity.fit(docs, frame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (5, None)], LABELS))
    assert " brave moron " in [f" {w} ".replace("  ", " ") for w in model["exceptions"]]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [(got[i].score >= 0.3) == bool(y) for i, _, y in rows if i % 2 == 0]
    assert sum(right) / len(right) > 0.95
    assert all(got[i].score >= 0.3 for i in (9003, 9004, 9005, 9006)) and all(got[i].score < 0.3 for i in (9001, 9002, 9007, 9008))
    assert toxicity.fit(docs, frame([(1, 1)], LABELS)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_matcher_against_plain_search():
    lexicon, exceptions = {" bad": 1.0, " worse ": 2.0}, [" not bad "]
    m = toxicity.Matcher(lexicon, exceptions)
    for text, n in (("bad", 1), ("Bad badly", 2), ("worse worsens", 1), ("not bad", 0), ("not bad bad", 1), ("", 0), ("b4d", 1)):
        assert len(m.hits(toxicity.fold(text))) == n, text


LANGS = {
    "en": "the of and to house water which there people".split(),
    "fr": "le la les des maison eau qui avec pour été".split(),
    "ru": "и в не на дом вода который люди".split(),
}


def test_languages_and_spans(spark, frame):
    rows = [(1000 * (k + 1) + i, t, lang) for k, (lang, w) in enumerate(LANGS.items()) for i, t in enumerate(texts(w, 60, k))]
    labelled = frame(rows + [(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert model["langs"] == ["en", "fr", "ru"]
    r = random.Random(1)
    mixed = " ".join(r.choices(LANGS["en"], k=10) + r.choices(LANGS["ru"], k=40) + r.choices(LANGS["fr"], k=10))
    given = [(1, None), (2, ""), (3, "123 !!!"), (4, mixed), (5, "дом"), (6, "les maisons " * 20_000), (7, "x" * 100_000), (8, "…")]
    docs = frame([(i, t, "q", 1.0) for i, t in given] + [(i, t, "q", 1.0) for i, t, _ in rows], "doc_id long, text string, lang_pred string, score double")
    got = {x.doc_id: x for x in langid.predict(docs, model).collect() if x.doc_id < 9 or x.doc_id > 0}
    assert [got[i].lang_pred for i in (2, 3, 5, 6, 8)] == ["und", "und", "ru", "fr", "und"]
    assert got[4].lang_pred == "ru" and got[4].n_spans == 3 and 0.4 < got[4].score < 0.9
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if i > 10) >= 0.97 * sum(i > 10 for i, *_ in rows)
    empty = langid.fit(labelled.limit(0))
    assert {x.lang_pred for x in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    lens = np.array([0, 1, 5, 3, 0, 6])
    starts = np.cumsum(lens) - lens
    scores = r.normal(size=(lens.sum(), 3)).astype(np.float32) * 3
    got = langid.viterbi(scores, starts, lens, 2.0)

    def value(path, s):
        return sum(scores[s + i][x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for s, n in zip(starts, lens, strict=True):
        if n:
            assert value(got[s : s + n].tolist(), s) == pytest.approx(max(value(p, s) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)


def test_two_hundred_languages():
    """Labels beyond 127 keep their numbers."""
    import numpy as np

    scores = np.full((4, 200), -5.0, np.float32)
    scores[:2, 180], scores[2:, 199] = 0, 0
    assert langid.viterbi(scores, np.array([0]), np.array([4]), 1.0).tolist() == [180, 180, 199, 199]


def test_frequent_n_grams_of_one_language_do_not_push_out_another(spark, frame, monkeypatch):
    monkeypatch.setattr(langid, "GRAMS", 40)
    rows = [(i, t, "en") for i, t in enumerate(texts(LANGS["en"], 300, 1))] + [(1000 + i, t, "fr") for i, t in enumerate(texts(LANGS["fr"], 6, 2))]
    model = langid.fit(frame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["en", "fr"] and any("é" in g or "m" in g for g in model["place"])


def plain_hits(folded, lexicon, exceptions):
    found = [(i, i + len(t)) for t in lexicon for i in range(len(folded)) if folded.startswith(t, i)]
    shields = [(i, i + len(p)) for p in exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    return sorted(h for h in found if not any(a <= h[0] and h[1] <= b for a, b in shields))


def test_matcher_on_random_texts():
    r = random.Random(9)
    for _ in range(200):
        lexicon = {f" {''.join(r.choices('ab', k=r.randrange(1, 4)))}{r.choice(['', ' '])}": 1.0 for _ in range(5)}
        exceptions = list({f" {''.join(r.choices('ab', k=r.randrange(1, 3)))} {''.join(r.choices('ab', k=r.randrange(1, 3)))} " for _ in range(4)} - set(lexicon))
        text = toxicity.fold(" ".join("".join(r.choices("ab", k=r.randrange(1, 5))) for _ in range(30)))
        got = sorted((a, b) for a, b, _ in toxicity.Matcher(lexicon, exceptions).hits(text))
        assert got == plain_hits(text, lexicon, exceptions)


def test_phrases_keep_long_neighbours():
    long = "x" * 300
    m = toxicity.Matcher({" bad": 1.0}, [])
    assert toxicity.phrases(m, f"{long} bad {long}") == {f" {long} bad ", f" bad {long} "}
    assert toxicity.phrases(m, "bad") == set()


def test_long_texts_train_the_quality_dictionaries(spark, frame):
    """Texts beyond one piece teach as well: here no text is shorter."""
    rows = [(i, " ".join(texts(GOOD, 1, i, 30_000)), 1) for i in range(16)] + [(100 + i, " ".join(texts(BAD, 1, 50 + i, 30_000)), 0) for i in range(16)]
    docs = frame([(i, t, "", 0) for i, t, _ in rows], DOCS)
    model = quality.fit(docs, frame([(i, y) for i, _, y in rows], LABELS))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(len(t) for _, t, _ in rows) > quality.PIECE and all((got[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_quality_sizes_against_the_library():
    import zstandard

    good, bad = (quality.dictionary([t.encode() for t in texts(w, 300, 7)]) for w in (GOOD, BAD))
    for t in (b"", b"river bread", " ".join(BAD * 50).encode()):
        x = quality.Sizes(good, bad).features([t])[0]
        n = [len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=False, write_content_size=False, write_dict_id=False).compress(t)) for d in (good, bad, b"")]
        assert x[0] == pytest.approx((n[1] - n[0]) / (len(t) + 32)) and x[4] == pytest.approx(n[2] / (len(t) + 32))


def test_repeated_rows_and_ties_score_alike(spark, frame):
    rows = [(i, t, i % 2) for i, t in enumerate(texts(GOOD + ["moron"], 80, 11))]
    docs = frame([(i, t, "", 0) for i, t, _ in rows for _ in range(2)], DOCS)
    labels = frame([(i, y) for i, _, y in rows], LABELS)
    for scored in (toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs, labels))):
        seen = {}
        for r in scored.collect():
            assert seen.setdefault(r.doc_id, r.score) == r.score
    tie = langid.fit(frame([(1, "same words here", "aa"), (2, "same words here", "bb")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(frame([(1, "same words"), (1, "same words")], "doc_id long, text string"), tie).collect()] == ["aa", "aa"]

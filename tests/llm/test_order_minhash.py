import random

import pytest

from tagspark.llm import order_minhash as om


def rows(n=90, seed=6):
    r = random.Random(seed)
    vocab = ["tree", "house", "Éa", "日本", "x"] + [f"w{i}" for i in range(60)]
    texts = [None, "", " \n", "one", "two words", "same " * 40, "a b c " * 30] + [" ".join(r.choices(vocab, k=r.randrange(1, 120))) for _ in range(n)]
    return [(i * 3, t, "s", 1) for i, t in enumerate(texts)]



def test_edited_texts_and_order(spark, frame):
    given = rows()
    got = {r.doc_id: r for r in om.edited_neighbours(frame(given, "doc_id long, text string, sig string, next int")).collect()}
    texts = [t or "" for _, t, *_ in given]
    for k, (i, *_) in enumerate(given):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].next_sig == got[given[(k + 1) % len(given)][0]].sig


@pytest.mark.parametrize("per_range", [1, 7, 10_000])
def test_ranges_change_nothing(spark, frame, monkeypatch, per_range):
    monkeypatch.setattr(om, "RANGE_ROWS", per_range)
    given = rows(60) + [(None, "no id", "", 0), (9, "again", "", 0), (9, "once more", "", 0)]
    got = om.edited_neighbours(frame(given, "doc_id long, text string, sig string, next int")).selectExpr("coalesce(doc_id, -1) d", "n_chars", "edited").collect()
    assert len(got) == len(given)
    order = spark.createDataFrame(given, "doc_id long, text string, a string, b int").selectExpr("coalesce(doc_id, -1) d", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) x").collect()
    texts = sorted(((r.d, r.x, r.t) for r in order))
    want = [(d, len(t), t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][2][: len(t) // 2]) for k, (d, _, t) in enumerate(texts)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_fingerprints_by_definition(spark, frame):
    """Every occurrence-numbered k-mer, the two smallest of each bin in text order, against plain loops."""
    given = rows(40)
    df = om.signatures(frame(given, "doc_id long, text string, sig__h string, k int"), "text", "sig")
    got = {r.doc_id: list(r.sig) for r in df.collect()}
    import re

    words = {i: [w for w in re.split(r"[\x09-\x0D\x20]+", t or "") if w] for i, t, *_ in given}
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for ws in words.values() for w in ws}], "w string").selectExpr("w", "xxhash64(w) h").collect()}

    def xx(*sql_rows):
        """xxhash64 of rows of longs (nulls allowed) or of one array."""
        return [r.h for r in spark.createDataFrame([(k, *x) for k, x in enumerate(sql_rows)], "k int, a long, b long, c long").selectExpr("k", "xxhash64(a, b, c) h").orderBy("k").collect()]

    grams, flat = {}, []
    for i, ws in words.items():
        h = [hashed[w] for w in ws]
        n = max(len(h) - 2, min(len(h), 1))
        grams[i] = [tuple(h[j + q] if j + q < len(h) else None for q in range(3)) for j in range(n)]
        flat += grams[i]
    table = dict(zip(flat, xx(*flat), strict=True))
    mask = (1 << 24) - 1
    numbered, ask = {}, []
    for i, g in grams.items():
        seen, out = {}, []
        for place, x in enumerate(g):
            top = table[x] >> 24
            out.append((top, seen.get(top, 0), place))
            seen[top] = seen.get(top, 0) + 1
        numbered[i] = out
        ask += [(t, o) for t, o, _ in out]
    ranks = dict(zip(ask, [r.h for r in spark.createDataFrame([(k, *x) for k, x in enumerate(ask)], "k int, a long, b int").selectExpr("k", "xxhash64(a, b) h").orderBy("k").collect()], strict=True))
    tuples, ask = {}, []
    for i, out in numbered.items():
        bins = {}
        for top, o, place in out:
            rank = (ranks[top, o] & ~mask) | place
            bins.setdefault((rank % (1 << 64)) >> 58, []).append((rank, place))
        tuples[i] = {b: [table[grams[i][p]] for p in sorted(p for _, p in sorted(v)[:2])] for b, v in bins.items()}
        ask += list(tuples[i].values())
    hashes = {tuple(a): r.h for a, r in zip(ask, spark.createDataFrame([(k, a) for k, a in enumerate(ask)], "k int, a array<long>").selectExpr("k", "xxhash64(a) h").orderBy("k").collect(), strict=True)}
    for i, t in tuples.items():
        assert sorted(got[i]) == sorted((b << 32) | (hashes[tuple(a)] & 0xFFFFFFFF) for b, a in t.items()), i


def test_likeness_follows_edits(spark, frame):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    variants = [" ".join(base[:k] + [f"v{r.randrange(10**6)}" for _ in base[k:]]) for k in (400, 360, 200, 0)] + [" ".join(base[200:] + base[:200])]
    df = om.signatures(frame([(0, " ".join(base), v) for v in variants], "doc_id long, text string, other string"), "text", "a")
    df = om.signatures(df, "other", "b").select("other", om.likeness("a", "b").alias("x"), om.printed("a").alias("fa"), om.printed("b").alias("fb"))
    near = {x.other: x for x in df.collect()}
    x = [near[v].x for v in variants]
    assert x[0] == 1 and near[variants[0]].fa == near[variants[0]].fb
    assert 1 > x[1] > x[2] > x[3] == 0 and x[4] < 1
    assert om.signatures(frame([], "doc_id long, text string"), "text", "a").count() == 0
    empty = om.edited_neighbours(frame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_one_document_follows_itself(spark, frame):
    r = om.edited_neighbours(frame([(5, "abcd", None, None)], "doc_id long, text string, sig string, next int", 1)).collect()
    assert [(x.doc_id, x.edited) for x in r] == [(5, "abab")]

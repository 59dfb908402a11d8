import random

import pytest

from tagspark.llm import decontam as dc

WORDS = "red green blue one two three Four five-six é日".split()


def tables(seed=3):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choices(WORDS, k=k))
    items = [(i, text(r.choice([1, 2, 5, 13, 14, 30]))) for i in range(20)] + [(3, text(20)), (50, None), (None, "red green"), (51, ""), (52, "...")]
    docs = [(i, text(r.randrange(0, 80))) for i in range(60)] + [(100, None), (101, ""), (102, ". - !"), (7, text(5)), (None, items[0][1]), (103, (items[4][1] or "") + " x " * 30000)]
    docs += [(200 + i, f"{text(10)}, {r.choice(items[:20])[1].upper()}; {text(10)}") for i in range(40)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_hits_by_brute_force(spark, frame, block):
    docs, items = tables()
    got = dc.contamination(frame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, items string, w string"), frame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), block_bytes=block)
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, sum(x["last"] - x["first"] for x in r.runs), sorted(r["items"])) for r in got.collect())
    want = sorted((-1 if i is None else i, *w) for (i, _), w in zip(docs, dc.brute_force([t for _, t in docs], items), strict=True))
    assert mine == want


def test_digest_and_stage(spark, frame):
    docs, items = tables(5)
    d = frame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_words int, runs string")
    b = frame(items, "item_id long, text string")
    rows = dc.digest(dc.contamination(d.select("doc_id", "text"), b)).collect()
    dirty = sum(r.contaminated for r in rows)
    for r in rows:
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert 0 < dirty < len(docs)
    kept = dc.clean(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) - dirty and kept.first().runs == "k"
    assert dc.clean(d, b.limit(0)).count() == len(docs)
    assert dc.contamination(d.limit(0), b).count() == 0

import random

import numpy as np
import pytest

from tagspark.llm import sais


def strings():
    r = random.Random(5)
    yield from (b"", b"a", b"aa", b"ba", b"ab", b"mississippi", b"abracadabra", b"a" * 50, b"ab" * 40, bytes(range(256)), bytes(range(255, -1, -1)), b"\xff\x00" * 9)
    for _ in range(150):
        yield bytes(r.choices(r.choice([b"ab", b"abc", bytes(range(256))]), k=r.randrange(1, 200)))
    for _ in range(30):
        parts = [bytes(r.choices(b"abcd ", k=r.randrange(1, 60))) for _ in range(4)]
        yield b"\xff".join(r.choices(parts, k=25))


def test_suffix_arrays_and_prefixes():
    for s in strings():
        t = np.frombuffer(s, np.uint8)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert sais.suffix_array(t).tolist() == want, s
        assert sais.suffix_array(t.astype(np.int64) * 1000).tolist() == want
        if len(s) > 1:
            got, phi = sais.common_prefixes(t, np.array(want, np.int32), np.array([0]), 4096)
            for before, i in zip(want, want[1:], strict=False):
                n = 0
                while max(i, before) + n < len(s) and s[i + n] == s[before + n]:
                    n += 1
                assert got[i] == n and phi[i] == before


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdé", k=r.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(r.randrange(8, 40))) for _ in range(6)]
    out = [None, "", "short", "ab" * 300, "ab" * 301, "lone passage of some bytes! " * 5, "this one stands twice, and between its ends there is no room for another" * 2, "x" * 1500, " ".join(passage), " ".join(passage)]
    for _ in range(120):
        parts = [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(3)]
        if r.random() < 0.7:
            parts.insert(r.randrange(3), r.choice(passage))
        if r.random() < 0.2:
            parts.append(parts[0] * 2)
        out.append(" ".join(parts))
    return out + out[20:30]


@pytest.mark.parametrize(("hot", "length", "gram"), [(2000, 60, 12), (3, 60, 12), (1, 60, 12), (1, 40, 38), (1, 64, 1)])
def test_dedup_by_brute_force(spark, frame, monkeypatch, hot, length, gram):
    from tagspark.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "HOT", hot)
    texts = corpus()
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    got = sd.dedup(frame(rows, "doc_id long, text string, spans string, row long"), length, gram).selectExpr("doc_id", "n_bytes", "aggregate(spans, 0L, (a, s) -> a + s.last - s.first) n", "size(spans) s", "sha2(kept, 256) k").collect()
    assert sorted(tuple(r) for r in got) == [(i, *w) for i, w in enumerate(sd.brute_force(texts, length))]


def test_stage_and_empty_table(spark, frame):
    from tagspark.llm import suffix_dedup as sd

    assert sd.dedup(frame([], "doc_id long, text string")).count() == 0
    long = "é" + "".join(chr(97 + i % 26) + str(i) for i in range(300))
    docs = frame([(1, "α" + long + "ω", "en", 9, 5), (2, "β" + long, "en", 8, 5), (3, None, None, None, 5), (4, "kept", "en", 4, 5)], "doc_id long, text string, lang string, n_chars long, z int")
    got = {r.doc_id: r for r in sd.shortened(docs).collect()}
    assert got[1].text == "αω"[0:1] + "ω" or got[1].text == "αω"
    assert got[2].text == "β" and got[2].n_chars == 1 and got[3].text is None and got[4].n_chars == 4 and got[1].z == 5

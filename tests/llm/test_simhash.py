import random

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")
from tagspark.llm import simhash as sh  # noqa: E402
from tagspark.llm.components import components  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plain(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = sorted(root)
    for i, a in enumerate(f):
        for b in f[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in f}


def documents(n=150, seed=2):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randrange(5, 300))) for _ in range(12)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two three"), (5, "Éa b  É\x0bx\x85y z"), (5, "Éa b  É\x0bx\x85y z"), (None, "one two three")]
    for i in range(10, 10 + n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append((i, " ".join(w)))
    return out


def test_fingerprint_by_definition():
    for _, t in documents(30):
        assert sh.fingerprint((t or "").encode()) == plain(t), t


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_bit_slices_find_every_link(radius):
    r = np.random.default_rng(1)
    unit, fps = [], []
    for u in range(60):
        centre = r.integers(0, 2**63, dtype=np.uint64)
        n = [1, 2, 5, 70, 200][u % 5]
        f = np.full(n, centre)
        for _ in range(5):
            f ^= np.where(r.random(n) < 0.5, np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
        f = np.unique(f)
        unit += [u] * len(f)
        fps += f.tolist()
    unit, fps = np.array(unit), np.array(fps, np.uint64)
    got = sh.block_links(unit, fps, radius)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert unit[a] == unit[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= radius
        assert find(a) != find(b)
        root[find(a)] = find(b)
    for u in range(60):
        at = np.flatnonzero(unit == u)
        want = roots([int(x) for x in fps[at]], radius)
        mine = {}
        for i in at:
            mine.setdefault(find(int(i)), set()).add(int(fps[i]))
        theirs = {}
        for x, y in want.items():
            theirs.setdefault(y, set()).add(x)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("tile", [4096, 7])
def test_components_by_brute_force(spark, frame, monkeypatch, tile):
    monkeypatch.setattr(sh.links, "__defaults__", (4, tile))
    docs = documents()
    rows = [(i, t, "f", 1) for i, t in docs]
    got = sh.near_duplicates(frame(rows, "doc_id long, text string, fp string, root int")).collect()
    want = roots([plain(t) for _, t in docs])
    low = {}
    for i, t in docs:
        if i is not None:
            root = want[plain(t)]
            low[root] = min(low.get(root, i), i)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((-1 if i is None else i, plain(t), low[want[plain(t)]]) for i, t in docs)
    kept = sh.distinct_documents(frame(rows, "doc_id long, text string, fp string, root int")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(low.values())
    assert set(kept[0].asDict()) == {"doc_id", "text", "fp", "root"}


def test_empty_tables(spark, frame):
    assert sh.near_duplicates(frame([], "doc_id long, text string")).count() == 0
    assert sh.distinct_documents(frame([], "doc_id long, text string, lang string")).columns == ["doc_id", "text", "lang"]


def test_components_of_chains_and_stars(spark, frame):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (41, 40), (500, 400)]
    got = {r.node: r.root for r in components(frame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(42)}, **{i: 100 for i in range(100, 160)}, 400: 400, 500: 400}

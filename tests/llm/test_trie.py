"""The prefix tree against dictionaries, at sizes that cut every shard, band and piece."""

import random

import numpy as np
import pytest

from tagspark.llm import ordered, prefix_trie
from tagspark.llm.prefix_trie import Slots, brute_force, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, place long"


def conversations(seed, n=160, words="ab"):
    r, rows = random.Random(seed), []
    for c in r.sample(range(1200), n):
        for t in range(r.randrange(0, 9)):
            rows.append((c, t, r.choice(["user", "bot", None]), r.choice([None, "", *words, "longer text"])))
    copies = [(t, "user", f"turn {t}") for t in range(7)]
    rows += [(5000 + i, *x) for i in range(120) for x in copies]  # copies, under other ids
    rows += [(4, None, "user", "first"), (4, None, "user", "also first"), (4, 3, "bot", "tie"), (4, 3, "bot", "tie"), (None, 0, "user", "nobody"), (-7, 1, "user", "x")]
    return rows


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(*x, 1, "own", 2) for x in rows], SCHEMA).repartition(5)
    got = trie(df, **sizes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    order = lambda x: sorted(x, key=lambda r: tuple(-1 if v is None else v for v in r))
    assert order(map(tuple, got.collect())) == order(brute_force(rows))


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"band": 2, "shard_rows": 7, "chunk": 20}), (3, {"band": 1, "shard_rows": 1, "chunk": 1})])
def test_against_brute_force(spark, seed, sizes):
    check(spark, conversations(seed), **sizes)


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(300, t, "user", f"t{t % 3}") for t in range(700)] + [(301, t, "user", f"t{t % 3}") for t in range(650)]
    check(spark, rows, band=64, shard_rows=100)


def test_empty_and_turnless(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "a", "b", 0, "", 0)], SCHEMA)).count() == 0
    turnless = [c for c in range(100, 200) if prefix_trie_h(c) >= 1][:3]
    check(spark, [(c, 0, "user", "gone") for c in turnless])


def prefix_trie_h(c):
    import zlib

    return zlib.crc32(str(c).encode()) % prefix_trie.SHARED


def test_slots_are_minimal_perfect_and_verified():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(r.integers(0, 1 << 62, (n, 3)).astype(np.uint64), axis=0)
        table = Slots(keys)
        assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
        assert (table.find(keys) == table.slots).all()
        strange = keys + np.array([1, 0, 0], np.uint64)
        assert (table.find(strange) == -1).all()
    with pytest.raises(ValueError):
        Slots(np.ones((2, 3), np.uint64))


def test_places_and_running_sums(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.randrange(1 << 61)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    sums = {(x.k, x.i): x.v for x in ordered.running_sums(df, "k", ["i"], ["v"], "sums").collect()}
    total = {}
    for k, i, v in sorted(rows):
        total[k] = (total.get(k, 0) + v) & ordered.MASK
        assert sums[k, i] == total[k]
    placed = sorted((x.at, (x.k, x.i)) for x in ordered.numbered(df, ["k", "i"], "at", "placed").collect())
    assert placed == list(enumerate(sorted((k, i) for k, i, _ in rows)))
    assert ordered.numbered(df.limit(0), ["k"], "at", "none").count() == 0

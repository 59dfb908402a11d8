"""SimHash near-duplicates: fingerprints compared in bit slices.

Two fingerprints within the radius agree in some two of six groups of bits, so each pair of groups is a
key under which candidates meet. There, bit k of all fingerprints stands in one row of machine words
(64 fingerprints a word). Comparing a block with itself, moved by d places, is an exclusive or for each bit
row; carry-save counters add up the differing bits of all 64 lanes at once, and words in which every
lane exceeds the radius are dropped before the rest of the bits is looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import aside, byte_list, in_batches, keep, slices, table
from tagspark.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
GROUPS = 6
#: Fingerprints under one key that a task compares at most; larger keys are dealt out in tiles.
TILE = 4096
#: Rows compared together, and words worked on at once.
ROWS, WORDS = 1 << 16, 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 majority bits over the shingles' hashes, repeats included; 0 without words."""
    w = text.lower().split()  # of bytes: A-Z alone change, and ASCII white space alone divides
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` with ``fp`` (the fingerprint as a signed long) and ``row``, a number of the row.

    Null counts as empty. ``row`` depends on the task that read the row: write the result before using it twice.
    """
    kept = [c for c in docs.columns if c not in ("fp", "row")]
    src = docs.select(*kept)
    schema = src.withColumns({"fp": F.lit(0).cast("long"), "row": F.lit(0).cast("long")}).schema

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t, size) for t in byte_list(part.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(fps), pa.array(np.arange(at, at + len(fps)))], schema.names)
                at += len(fps)

    return in_batches(src, run, schema)


def keys(fp: Column, radius: int, groups: int = GROUPS) -> Column:
    """The keys of a fingerprint: every choice of ``groups - radius`` bit groups, with the bits in them."""
    edges = [64 * i // groups for i in range(groups + 1)]
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*(F.xxhash64(F.lit(i), *(parts[k] for k in chosen)) for i, chosen in enumerate(combinations(range(groups), groups - radius))))


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit k of all fingerprints side by side in row k; one word more than needed, for moved reads."""
    n = -(-len(fp) // 64) + 2
    bits = np.zeros((64, n * 64), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close(rows: np.ndarray, word: np.ndarray, move: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the masked lanes of each word differ from those ``move`` rows on in at most ``radius`` bits.

    Returns the places in ``word`` that keep a lane, and their lanes.
    """
    width = max(1, radius.bit_length())
    at, alive = np.arange(len(word)), mask
    low, shift = word + (move >> 6), (move & 63).astype(np.uint64)
    count = [np.zeros(len(word), np.uint64) for _ in range(width)]
    over = np.zeros(len(word), np.uint64)

    def add(bits, level):
        for k in range(level, width):
            count[k], bits = count[k] ^ bits, count[k] & bits
        return bits

    for k in range(0, 64, 3):
        d = []
        for row in rows[k : k + 3]:
            high = np.where(shift > 0, row[low + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            d.append(row[word] ^ ((row[low] >> shift) | high))
        if len(d) == 3:  # carry-save: three bits of weight one become one of weight one and one of weight two
            half = d[0] ^ d[1]
            over |= add(half ^ d[2], 0) | (add((d[0] & d[1]) | (half & d[2]), 1) if width > 1 else (d[0] & d[1]) | (half & d[2]))
        else:
            for x in d:
                over |= add(x, 0)
        if k % 6 == 3 or k >= 60:
            more, equal = np.zeros_like(over), ~np.zeros_like(over)  # count > radius, from the top bit down
            for j in reversed(range(width)):
                if radius >> j & 1:
                    equal &= count[j]
                else:
                    more |= equal & count[j]
                    equal &= ~count[j]
            alive = alive & ~(over | more)
            left = np.flatnonzero(alive)
            if len(left) < len(alive):
                if not len(left):
                    return at[:0], alive[:0]
                at, alive, over, word, low, shift = at[left], alive[left], over[left], word[left], low[left], shift[left]
                count = [c[left] for c in count]
    return at, alive


class Forest:
    """Links that join two trees; all others are dropped, so a group of n leaves n - 1 links at most."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            ra, rb = self.root[a], self.root[b]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)  # each root is hung up once, under a smaller one
            self.root[high[first]] = low[first]
            self.links += zip(a[first].tolist(), b[first].tolist(), strict=True)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def block_links(unit: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside units; ``unit`` is sorted."""
    n = len(fp)
    new = np.r_[True, unit[1:] != unit[:-1]]
    ends = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1]
    after = ends - np.arange(n) - 1  # rows of the unit that follow
    rows, forest = planes(fp), Forest(n)
    held_w, held_d, held_m, size = [], [], [], 0

    def flush():
        nonlocal held_w, held_d, held_m, size
        if size:
            word, move, mask = np.concatenate(held_w), np.concatenate(held_d), np.concatenate(held_m)
            at, alive = close(rows, word, move, mask, radius)
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(lanes)
            a = word[at[i]] * 64 + lane
            forest.add(a, a + move[at[i]])
        held_w, held_d, held_m, size = [], [], [], 0

    left = np.arange(n)
    for d in range(1, int(after.max(initial=0)) + 1):
        left = left[after[left] >= d]
        word = left >> 6
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        held_w.append(word[first])
        held_m.append(np.bitwise_or.reduceat(np.uint64(1) << (left & 63).astype(np.uint64), first))
        held_d.append(np.full(len(first), d))
        size += len(first)
        if size >= WORDS:
            flush()
    flush()
    return forest.links


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that lie within the radius.

    Not every close pair is listed, but every close pair is connected. Keys of one fingerprint go; a key of
    more than ``tile`` is dealt out in tiles, each pair of which is compared in a task of its own.
    """
    groups = radius + 2
    keyed = nodes.select("fp", F.explode(keys(F.col("fp"), radius, groups)).alias("key"))
    # written, so that a frequent key's rows meet its size in a plain join, which adaptive execution splits
    sizes = keep(keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tile).alias("tiles")), "key-sizes")
    met = keyed.join(sizes, "key")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.xxhash64("key", F.least(own, t), F.greatest(own, t)))
    units = met.select("fp", F.explode(F.when(F.col("tiles") == 1, F.array("key")).otherwise(pairs)).alias("unit"))

    def run(batches):
        unit, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(u, f):
            found = np.array(block_links(u, f, radius), np.int64).reshape(-1, 2)
            f = f.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(f[found[:, 0]]), pa.array(f[found[:, 1]])], ["a", "b"])

        for batch in batches:
            unit = np.r_[unit, batch.column("unit").to_numpy()]
            fp = np.r_[fp, batch.column("fp").to_numpy().view(np.uint64)]
            if len(unit) >= ROWS:
                cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
                if cut:
                    yield out(unit[:cut], fp[:cut])
                    unit, fp = unit[cut:], fp[cut:]
        if len(unit):
            yield out(unit, fp)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, "unit").sortWithinPartitions("unit", "fp")
    return in_batches(dealt, run, "a long, b long")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): every distinct fingerprint of ``rows`` with the smallest one that links reach from it."""
    nodes = keep(rows.select("fp").distinct(), "fingerprints")
    found = components(links(nodes, radius))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id among those linked, itself included.

    Equal fingerprints are one node whatever their number. Null and empty texts have fingerprint 0; null
    ids count as no id: a component of such rows alone has a null id. Ties and repeated rows share a component.
    """
    rows = keep(with_fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"), "simhash")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = keep(classes(rows, radius), "classes")
    ids = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one of the smallest id (rows without one come last)."""
    own, back = aside(docs, "fp", "row")
    rows = keep(with_fingerprints(own, size), "simhash-documents")
    narrow = rows.select("doc_id", "fp", "row")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    best = narrow.groupBy("fp").agg(F.min(order).alias("o")).join(classes(narrow, radius), "fp")
    kept = best.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.r").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*back)


def op5_simhash(spark, sf: str) -> DataFrame:
    out = near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Prefix tree of conversations: how many share each beginning, and what sharing saves.

Every distinct sequence of first turns is a node, named by its depth and a digest that adds up over the turns.
Nodes are found by one grouping of all (conversation, depth) rows; equal rows are summed before the shuffle, so a
beginning that a third of the conversations share costs one row a task.

Sums over subtrees are taken in shards of whole paths. The smallest conversation of a node also is the smallest of
those below it on its path, so every node is owned by one conversation, and a shard of some conversations' paths counts
each node it owns once. A shard enumerates its distinct digests, gives them slots by a minimal perfect hash
(:class:`Slots`) that checks the digest held in a slot, scatters its nodes' values into flat arrays and adds them up from
slot to parent slot, deepest first. The shards' parts of a node are then summed. A path of more than ``BAND`` turns is cut; the
sum below a cut goes to the last turn above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, keep, table
from tagspark.llm.ordered import MASK, partitions, running_sums

#: Turns that a conversation takes from the one its hundred begins with: the rest of a crc32 by this.
SHARED, HUNDRED = 6, 100
#: Depths of a path that stay together; path rows of a shard (a shard ends with a path).
BAND, SHARD_ROWS = 1 << 16, 1 << 18
#: Bytes of a run of ids that is hashed in one piece.
CHUNK = 64 << 10
KEY = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


class Slots:
    """A minimal perfect hash over distinct keys (three uint64 columns): n keys, slots 0 to n - 1, none empty.

    Keys that alone fall on a place of a level's bit array take it; the others go on to the next level. A slot is
    the number of set bits before its place. ``find`` compares the key held in the slot, so a strange key gives -1.
    """

    ROOM, LEVELS = 2, 40

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, done = np.arange(len(keys)), 0
        slots = np.empty(len(keys), np.int64)
        while len(left):
            if len(self.levels) == self.LEVELS:
                raise ValueError("keys are not distinct")
            size = max(2, self.ROOM * len(left))
            at = self._places(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = done + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            good = alone[at]
            slots[left[good]] = rank[at[good]]
            done += int(good.sum())
            left = left[~good]
        self.keys = np.empty_like(keys)
        self.keys[slots] = keys
        self.slots = slots

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(len(keys), np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & ((1 << 64) - 1)))
            for i in range(keys.shape[1]):
                h = (h ^ keys[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(32)
        return (h % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._places(keys[left], level, len(alone))
            good = alone[at]
            slots[left[good]] = rank[at[good]]
            left = left[~good]
        there = slots >= 0
        there[there] = (self.keys[slots[there]] == keys[there]).all(axis=1)
        return np.where(there, slots, -1)


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns numbered from 0 by ``turn``, null first; ties in the order of their digests.

    Null roles and texts count as empty; turns without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("pos"),
    )
    return running_sums(rows, "conv_id", ["turn", "digest"], ["pos"], "turns").select("conv_id", (F.col("pos") - 1).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and rows (conv_id, depth from 1, digest, chars, length) of the rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % 100 (h: crc32 of its decimals, modulo 6) and goes on
    with its own after its first h. A turn goes to a hundred conversations at most.
    """
    counts = keep(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = counts.withColumns({"h": h, "donor": F.col("conv_id") - F.col("conv_id") % HUNDRED})
    held = convs.join(counts.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n")), "donor", "left")
    given = F.least("h", F.coalesce("donor_n", F.lit(0)))
    convs = keep(held.withColumn("k", given).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "lengths")
    own = turns.join(convs.select("conv_id", "h", "k", "length"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "chars", "length")
    lent = turns.where(F.col("pos") < SHARED - 1).withColumnRenamed("conv_id", "donor").join(convs.where("k > 0").select("conv_id", "donor", "k", "length"), "donor").where("pos < k")
    return convs.select("conv_id", "length"), own.unionByName(lent.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "chars", "length"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows with (a, b), the digest of the first ``depth`` turns, and (up_a, up_b), that of one turn less."""

    def lane(i: int) -> Column:  # the number comes first, so that the lanes share no state
        return F.xxhash64(F.lit(i), "digest", "depth").bitwiseAND(F.lit(MASK))

    sums = running_sums(rows.withColumns({"a": lane(1), "b": lane(2)}), "conv_id", ["depth"], ["a", "b"], "prefixes")
    return sums.withColumns({f"up_{c}": (F.col(c) - lane(i)).bitwiseAND(F.lit(MASK)) for i, c in ((1, "a"), (2, "b"))})


def node_table(rows: DataFrame) -> DataFrame:
    """One row for each node below the root. Fails if two sequences of turns ever share a digest."""
    same = [F.min(c) == F.max(c) for c in ("digest", "up_a", "up_b")]
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), (same[0] & same[1] & same[2]).alias("same"),
    )
    return found.withColumn("n_convs", F.when(F.col("same"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two beginnings share a digest")).cast("long"))).drop("same")


def subtree_sums(rows: DataFrame, nodes: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(depth, a, b, n_leaves, saved) with the root as (0, 0, 0): parts of shards, summed. ``nodes`` has ``n_children``."""
    owned = nodes.select(
        "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")
    )
    owners = owned.select("conv_id").distinct()
    paths = rows.select("conv_id", *KEY, "up_a", "up_b", "length").join(owners, "conv_id", "left_semi").join(owned, ["conv_id", "depth"], "left")
    paths = paths.fillna(0, ["saved", "leaves"]).withColumn("band", F.floor((F.col("depth") - 1) / band))
    if not rows.where(F.col("length") > band).isEmpty():
        paths = keep(paths, "paths")
        by_band = paths.groupBy("conv_id", "band").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.max("depth").alias("depth"))
        below = Window.partitionBy("conv_id").orderBy("band").rowsBetween(1, Window.unboundedFollowing)  # a row for each BAND turns
        more = by_band.select("conv_id", "depth", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("s", "l")))
        paths = paths.join(more, ["conv_id", "depth"], "left").withColumns(
            {"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))}
        )
    columns = ["conv_id", "band", *KEY, "up_a", "up_b", "saved", "leaves"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _path_ends(batch)
            if size >= shard_rows and held:
                # the shard ends where the path that it holds last does
                last = held[-1].slice(held[-1].num_rows - 1)
                go_on = last.column("conv_id")[0] == batch.column("conv_id")[0] and last.column("band")[0] == batch.column("band")[0]
                if not go_on:
                    yield _accumulated(held)
                    held, size = [], 0
                elif len(cut):
                    yield _accumulated([*held, batch.slice(0, cut[0])])
                    held, size, batch = [], 0, batch.slice(cut[0])
            held.append(batch)
            size += batch.num_rows
        if held:
            yield _accumulated(held)

    sharded = paths.select(*columns).repartition(partitions(rows), "conv_id", "band").sortWithinPartitions("conv_id", "band", "depth")
    parts = in_batches(sharded, run, "depth long, a long, b long, n_leaves long, saved long")
    return parts.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _path_ends(batch: pa.RecordBatch) -> np.ndarray:
    c, b = batch.column("conv_id").to_numpy(), batch.column("band").to_numpy()
    return np.flatnonzero((c[1:] != c[:-1]) | (b[1:] != b[:-1])) + 1


def _accumulated(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    depth, saved, leaves, band = (t.column(c).to_numpy() for c in ("depth", "saved", "leaves", "band"))
    keys = np.c_[tuple(t.column(c).to_numpy() for c in KEY)].astype(np.uint64)
    ups = np.c_[depth - 1, t.column("up_a").to_numpy(), t.column("up_b").to_numpy()].astype(np.uint64)
    first = band != np.r_[-1, band[:-1]]  # a band's first turn hangs on the path above, which is not here, or on the root
    conv = t.column("conv_id").to_numpy()
    first |= conv != np.r_[conv[0], conv[:-1]]
    first[0] = True
    ups_known = ~first | (depth == 1)
    every, at = np.unique(np.r_[keys, np.zeros((1, 3), np.uint64)], axis=0, return_index=True)
    table_ = Slots(every)
    slot = table_.find(keys)
    parent = np.full(len(every), -1)
    parent[slot[ups_known]] = table_.find(ups[ups_known])
    sums = np.zeros((2, len(every)), np.int64)
    np.add.at(sums[0], slot, leaves)
    np.add.at(sums[1], slot, saved)
    level = table_.keys[:, 0].astype(np.int64)
    order = np.argsort(-level, kind="stable")
    for lo, hi in _groups(level[order]):
        here = order[lo:hi]
        here = here[parent[here] >= 0]
        np.add.at(sums[0], parent[here], sums[0, here])
        np.add.at(sums[1], parent[here], sums[1, here])
    some = np.flatnonzero((sums != 0).any(axis=0))
    found = table_.keys[some].astype(np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(3)), pa.array(sums[0, some]), pa.array(sums[1, some])], [*KEY, "n_leaves", "saved"])


def _groups(x: np.ndarray):
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(x)].tolist(), strict=True)


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(depth, a, b, ends_sha256) of the ids (conv_id) that end at each node, ascending and joined by commas.

    Ranges of (node, id) write their ids in pieces first; a node's pieces are then hashed one after the other, so
    a node of very many ids costs its task a few long strings and no memory.
    """

    def pieces(batches):
        now, first, ids, size = None, 0, [], 0

        def piece():
            return (*now, first, ",".join(ids))

        for batch in batches:
            out = []
            for *key, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv_id")), strict=True):
                if key != now or size >= chunk:
                    if ids:
                        out.append(piece())
                    now, first, ids, size = key, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _rows(out)
        if ids:
            yield _rows([piece()])

    def _rows(out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*[pa.int64()] * 4, pa.string()], strict=True)], [*KEY, "first", "ids"])

    def hashed(batches):
        now, h = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield _digests(out)
        if now is not None:
            yield _digests([(*now, h.hexdigest())])

    def _digests(out):
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*[pa.int64()] * 3, pa.string()], strict=True)], [*KEY, "ends_sha256"])

    by = [*KEY, "conv_id"]
    ranged = ends.select(*by).repartitionByRange(partitions(ends), *by).sortWithinPartitions(*by)
    runs = in_batches(ranged, pieces, "depth long, a long, b long, first long, ids string")
    dealt = runs.repartition(partitions(ends), *KEY).sortWithinPartitions(*KEY, "first")
    return in_batches(dealt, hashed, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK) -> DataFrame:
    """The nodes of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns are passed over. Null role or text counts as empty,
    null turns come first, turns of equal number are ordered by their content's digest, repeated rows are turns of their own, turns without
    conv_id are left out. Without any conversation there is no node, not even a root.
    """
    convs, rows = rebuilt(positions(conversations))
    rows = prefixes(rows)
    root = F.lit(0).cast("long")
    found = keep(node_table(rows), "nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    children = keep(children, "children")
    nodes = found.join(children, KEY, "left").fillna(0, ["n_children"])
    sums = subtree_sums(rows, nodes, band, shard_rows)
    ends = rows.where("depth = length").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(*(root.alias(c) for c in KEY), "conv_id"))
    ends = end_digests(ends, chunk)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    every = nodes.drop("chars").unionByName(top.select(*(root.alias(c) for c in KEY), "conv_id", "n_convs", *(root.alias(c) for c in ("up_a", "up_b"))).join(children, KEY, "left").fillna(0, ["n_children"]))
    # a node has its parent's smallest conversation or a larger one; only the first node that a conversation owns has another's
    parents = every.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id")).where("n_children > 0")
    out = every.join(sums, KEY, "left").join(ends, KEY, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.coalesce("n_leaves", root)).alias("n_leaves"),
        F.coalesce("saved", root).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf: str) -> DataFrame:
    return trie(table(spark, sf, "conversations"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """For tests: the nodes of (conv_id, turn, role, text) rows, by dictionaries."""
    import zlib
    from collections import defaultdict

    own: dict = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[:2], hashlib.sha256(f"{len(y[2])}:{y[2]}{y[3]}".encode()).digest()[:16]))] for c, x in own.items()}
    members, made = defaultdict(list), {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % SHARED
        made[c] = tuple(own.get(c - c % HUNDRED, [])[:h] + x[h:])
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if made[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)

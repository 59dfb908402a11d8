"""Best-fit packing by minimum bin slack.

Documents are cut in place into pieces of at most ``capacity`` ids. How the pieces share sequences
depends on their lengths alone, so the search works on the counts of the lengths, of which there are
at most ``capacity``: the longest length left opens a sequence, a subset-sum over bit sets of the
available lengths finds the fullest combination beside it, and that combination is taken out as
often as its lengths allow. Pieces then find their places by their rank among pieces of their length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, keep, slices, table, text_list
from tagspark.llm.pretok import encoder

CAPACITY, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of each document: doc_id, piece (from 0), start, length, ids (little-endian, four bytes each).

    A document is its ids and ``end``; null and empty texts are one piece that holds ``end`` alone.
    Repeated rows are pieces of their own; a null doc_id stays null.
    """

    def pieces(batches):
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(text_list(part.column("text"))), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    out += [(doc, k, at, min(capacity, len(ids) - at), ids[at : at + capacity].tobytes()) for k, at in enumerate(range(0, len(ids), capacity))]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return in_batches(docs.select("doc_id", "text"), pieces, PIECES)


def fullest(left: dict[int, int], room: int) -> Counter:
    """The combination of available lengths (each at most as often as it is left) with the largest sum up to ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        times, part = min(left[length], room // length), 1
        while times:
            take = min(part, times)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            times -= take
            part *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            chosen[length] += take
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """(how many sequences, lengths in each) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        use = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        use[longest] += 1
        times = min(left[k] // n for k, n in use.items())
        out.append((times, use))
        for k, n in use.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def places(found: list[tuple[int, Counter]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by rank: key (length, first rank), first sequence, pieces of the length in each, offset of the first.

    At most one row for each length of each pattern, and each pattern uses up a length: bounded by the capacity.
    """
    rows, first, rank = [], 0, Counter()
    for times, use in found:
        offset = 0
        for length in sorted(use, reverse=True):
            rows.append((length << 48 | rank[length], first, use[length], offset))
            rank[length] += times * use[length]
            offset += length * use[length]
        first += times
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("key", "first", "each", "offset"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces`` (``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    A piece's rank among its length is its rank in the task that wrote it plus what the tasks before
    hold of that length; so no length, however frequent, meets in one task. Carried columns should be
    narrow: they are written to the shared folder once and joined by (task, length).
    """

    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "task", "rank")]
    src = pieces.select(*kept)
    schema = src.withColumns({"task": F.lit(0), "rank": F.lit(0).cast("long")}).schema

    def ranked(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ranks = []
            for n in batch.column("length").to_pylist():
                ranks.append(seen[n])
                seen[n] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], schema.names)

    rows = keep(in_batches(src, ranked, schema), "pieces")
    counted = rows.groupBy("task", "length").count()
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("task", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("earlier"))
    sums = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    if any(not 0 < n <= capacity for n in sums):
        raise ValueError(f"a piece is empty or longer than {capacity}")
    sent = pieces.sparkSession.sparkContext.broadcast(places(patterns(sums, capacity)))
    placed = rows.join(base, ["task", "length"]).select(*kept, (F.col("rank") + F.col("earlier")).alias("rank"))
    result = src.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches):
        p = sent.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
            at = np.searchsorted(p["key"], length << 48 | rank, side="right") - 1
            beyond = rank - (p["key"][at] & ((1 << 48) - 1))
            sequence, slot = p["first"][at] + beyond // p["each"][at], beyond % p["each"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(p["offset"][at] + slot * length)], result.names)

    return in_batches(placed, place, result)


def packed(docs: DataFrame) -> DataFrame:
    """The contract's rows: pieces without their ids, which ``cut`` gives again by doc_id and piece."""
    pieces = cut(docs, public_tokenizers.path("word_bpe_49k.json"))
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))

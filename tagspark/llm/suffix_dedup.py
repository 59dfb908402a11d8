"""Exact removal of long repeated byte strings with suffix arrays over shards.

A repeated string of ``LENGTH`` bytes has the same smallest hash of short substrings wherever it stands.
Runs of places that share such a hash are a *segment*; hashes that occur once in the corpus cannot
belong to a repeat, and their segments go no further. The other segments, equal ones once with their number, are
dealt out by the hash, so all copies of a string meet in one shard, and only there. A shard's suffixes are
sorted by induced sorting; permuted common prefixes say which starts repeat. A suffix of a segment
that stands for several repeats as it is. The repeats go back to every place of their segment.

A hash with more than ``HOT`` different segments is cut finer before: into starts of the same distance
from the hash, dealt by the bytes they share, and at last into single strings, of which equal ones are one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import aside, in_batches, keep, settle, slices, table
from tagspark.llm.sais import common_prefixes, suffix_array

LENGTH, GRAM = 400, 48
#: Pipeline stage: bytes that repeats are looked for with, and words from which on such a run is a passage.
PASSAGE_BYTES, PASSAGE_WORDS = 250, 50
#: Starts in a segment at most; longer runs of one hash are cut.
RUN = 1024
#: Different segments of one hash beyond which it is cut finer; bytes of a shard; starts of a finer cut.
HOT, SHARD, STEP = 2000, 640 << 10, 16
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Stands between segments; no UTF-8 text holds it.
BREAK = b"\xff"
PLACES = "row long, h long, seg long, start long, size int, stands int"
SEGMENTS = "h long, seg long, times long, text binary"


def gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, by doubling."""
    h = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    out, done, width, power, left = None, 0, 1, MULT, gram
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out = h
                else:
                    n = len(t) - done - width + 1
                    out = out[:n] * power + h[done : done + n]
                done += width
            left >>= 1
            if left:
                n = len(t) - 2 * width + 1
                h = h[:n] * power + h[width : width + n]
                width, power = 2 * width, power * power
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum over ``width`` values from each place."""
    low, span = x, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(x) - width + 1
    return np.minimum(low[:n], low[width - span : width - span + n])


def segments(text: bytes, length: int, gram: int) -> list[tuple[int, int, int, int, int]]:
    """(hash, digest, first byte, bytes, how often the hash stands) of each segment; together they hold every start once.

    A hash counts as standing twice if it stands at several places of one run, whose strings may then repeat each other.
    """
    if len(text) < length:
        return []
    x = gram_hashes(np.frombuffer(text, np.uint8), gram)
    low = smallest(x, length - gram + 1)
    new = low[1:] != low[:-1]
    first = np.flatnonzero(np.r_[True, new])
    # the run goes on though its hash is left behind: it stands again further on
    twice = np.logical_or.reduceat(np.r_[(x[: len(low) - 1] == low[:-1]) & ~new, False], first)
    hashes, ends = low[first].view(np.int64).tolist(), np.r_[first[1:], len(low)].tolist()
    out = []
    for h, a, e, again in zip(hashes, first.tolist(), ends, twice.tolist(), strict=True):
        for at in range(a, e, RUN):
            size = min(RUN, e - at) + length - 1
            out.append((h, xxhash.xxh3_64_intdigest(text[at : at + size]) - (1 << 63), at, size, 2 if again else 1))
    return out


def repeats(texts: list[bytes], times: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each segment of a shard its runs (first, last) of starts whose ``length`` bytes start elsewhere too."""
    joined = BREAK.join([*texts, b""])
    t = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(x) for x in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    sa = suffix_array(t)
    prefix, neighbour = common_prefixes(t, sa, begins, RUN + length)
    hit = np.flatnonzero(prefix >= length)
    again = np.zeros(len(t) + 1, bool)
    again[hit] = again[neighbour[hit]] = True
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    again[:-1] &= begins[owner] + sizes[owner] - np.arange(len(t)) >= length
    several = np.array(times) > 1
    again[:-1] |= several[owner] & (begins[owner] + sizes[owner] - np.arange(len(t)) >= length)
    turn = np.flatnonzero(again[1:] != again[:-1]) + 1
    bounds = np.r_[0, turn] if again[0] else turn
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, e in bounds.reshape(-1, 2).tolist():
        k = int(owner[a])
        out[k].append((a - int(begins[k]), e - int(begins[k])))
    return out


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
FOUND = "h long, seg long, runs array<struct<first:int,last:int>>"


def _sorted_shards(segs: DataFrame, length: int) -> DataFrame:
    """Repeats of all segments; those of one hash are in one shard, a shard is about ``SHARD`` bytes."""

    def run(batches):
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def out(rows):
            found = repeats([r[3] for r in rows], [r[2] for r in rows], length)
            full = [(r[0], r[1], [{"first": a, "last": e} for a, e in runs]) for r, runs in zip(rows, found, strict=True) if runs]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in full], pa.int64()), pa.array([x[1] for x in full], pa.int64()), pa.array([x[2] for x in full], RUNS)], ["h", "seg", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "seg", "times", "text")), strict=True):
                if size >= SHARD and held[-1][0] != row[0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
            settle()
        if held:
            yield out(held)

    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_batches(segs.select("h", "seg", "times", "text").repartition(parts, "h").sortWithinPartitions("h"), run, FOUND)


def _finer(segs: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """Cuts of hot segments: (h, seg, times, shift, h2, seg2, text), ``step`` starts each.

    A start's distance from the first place of the smallest hash in its string belongs to the string, so
    equal strings come into cuts of the same distances; those are dealt by the bytes that all their starts share.
    """

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def table_of(out):
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["h", "seg", "times", "shift", "h2", "seg2", "text"])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for h, seg, times, text in zip(*(batch.column(c).to_pylist() for c in ("h", "seg", "times", "text")), strict=True):
                if len(out) >= 1 << 13:
                    yield table_of(out)
                    out = []
                if step == 1:
                    for a in range(len(text) - length + 1):
                        key = xxhash.xxh3_64_intdigest(text[a : a + length]) - (1 << 63)
                        out.append((h, seg, times, a, key, key, text[a : a + length]))
                    continue
                places = np.flatnonzero(gram_hashes(np.frombuffer(text, np.uint8), gram) == np.uint64(h % (1 << 64)))
                starts = np.arange(len(text) - length + 1)
                anchor = places[np.searchsorted(places, starts)]
                group = (anchor - starts) // step
                first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (anchor[1:] != anchor[:-1])])
                for a, e, g, at in zip(first.tolist(), np.r_[first[1:], len(starts)].tolist(), group[first].tolist(), anchor[first].tolist(), strict=True):
                    # a whole cut starts at distances g * step to g * step + step - 1; all of these strings hold the bytes between
                    shared = text[max(at - g * step, 0) : at - g * step - step + 1 + length]
                    cut = text[a : e - 1 + length]
                    key = xxhash.xxh3_64_intdigest(shared, seed=g + 1) - (1 << 63)
                    out.append((h, seg, times, a, key, xxhash.xxh3_64_intdigest(cut) - (1 << 63), cut))
            yield table_of(out)
            settle()

    return in_batches(segs.select("h", "seg", "times", "text"), run, "h long, seg long, times long, shift int, h2 long, seg2 long, text binary")


def _found(segs: DataFrame, length: int, gram: int, steps: list[int]) -> DataFrame:
    """Repeats of all segments (h, seg, times, text), hot hashes cut by the next of ``steps`` first."""
    if not steps:
        return _sorted_shards(segs, length)
    hot = keep(segs.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot")
    if hot.isEmpty():
        return _sorted_shards(segs, length)
    cuts = keep(_finer(segs.join(hot, "h", "left_semi"), length, gram, steps[0]), "cuts")
    sums = cuts.groupBy("h2", "seg2").agg(F.sum("times").alias("times"), F.first("text").alias("text"))
    several = cuts.groupBy("h2").agg(F.sum("times").alias("n")).where("n > 1").select("h2")  # bytes that only one start's string has repeat nowhere
    part = keep(sums.join(several, "h2", "left_semi").select(F.col("h2").alias("h"), F.col("seg2").alias("seg"), "times", "text"), "cut-segments")
    deeper = _found(part, length, gram, steps[1:]).withColumnsRenamed({"h": "h2", "seg": "seg2"})
    back = cuts.select("h", "seg", "shift", "h2", "seg2").join(deeper, ["h2", "seg2"])
    moved = back.select("h", "seg", F.transform("runs", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last"))).alias("runs"))
    hot_found = moved.groupBy("h", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return _sorted_shards(segs.join(hot, "h", "left_anti"), length).unionByName(hot_found)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with ``row`` and ``z`` (their bytes, compressed) instead of ``text``, and (row, spans) to remove."""
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept, F.lit(0).cast("long").alias("row"), F.lit(None).cast("binary").alias("z")).schema

    def number(batches):
        at, zip_ = TaskContext.get().partitionId() << 40, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                z = [None if t is None else zip_.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(range(at, at + len(z)), pa.int64()), pa.array(z, pa.binary())], schema.names)
                at += len(z)

    wide = keep(in_batches(docs.select(*kept, "text"), number, schema), "numbered")

    def place(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for row, z in zip(batch.column("row").to_pylist(), batch.column("z").to_pylist(), strict=True):
                if z is not None:
                    out += [(row, *x) for x in segments(unzip.decompress(z), length, gram)]
                if len(out) >= 1 << 14:
                    yield _places(out)
                    out = []
            yield _places(out)
            settle()

    places = keep(in_batches(wide.select("row", "z"), place, PLACES), "places")
    # written, so that a frequent hash meets it in a plain join, which adaptive execution splits
    again = keep(places.groupBy("h").agg(F.sum("stands").alias("n")).where("n > 1").select("h"), "again")
    places = keep(places.join(again, "h"), "places-again")
    one = places.groupBy("h", "seg").agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "size")).alias("at"))
    wanted = one.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("h", "seg", "times", "at.start", "at.size")).alias("cuts"))

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, cuts in zip(batch.column("z").to_pylist(), batch.column("cuts"), strict=True):
                text = unzip.decompress(z)
                rows = [(c["h"], c["seg"], c["times"], text[c["start"] : c["start"] + c["size"]]) for c in cuts.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["h", "seg", "times", "text"])

    segs = keep(in_batches(wide.select("row", "z").join(wanted, "row").select("z", "cuts"), cut, SEGMENTS), "segments")
    found = keep(_found(segs, length, gram, [STEP, 1]), "found")
    spans = places.join(found, ["h", "seg"]).select("row", F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"] + (length - 1)).alias("last"))).alias("s"))
    return wide, spans.groupBy("row").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = [*[pa.int64()] * 4, *[pa.int32()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "h", "seg", "start", "size", "stands"])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False, words: int = 0) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``kept`` (the bytes that stay), ``n_bytes`` and ``spans`` (removed runs).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text too; all
    copies go, the first as well, and strings are judged on the input. Texts are bytes of UTF-8; null counts as
    empty, and texts shorter than ``length`` stay whole. With ``as_text``, ``kept`` is text, in which a cut
    character leaves nothing. With ``words``, runs of fewer words (between white space) and under ``LENGTH`` bytes stay.
    Repeated rows are copies of each other. Columns named like the results, ``row`` or ``z`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "row", "z", "kept", "n_bytes", "spans")]
    wide, spans = repeated_spans(docs.select(*kept, "text"), length, gram)
    src = wide.join(spans, "row", "left").select(*kept, "z", "spans")
    result = src.select(*kept, F.lit("" if as_text else b"").alias("kept"), F.lit(0).cast("long").alias("n_bytes"), F.col("spans")).schema

    def remove(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                stay, sizes, gone = [], [], []
                for z, found in zip(part.column("z").to_pylist(), part.column("spans"), strict=True):
                    text = b"" if z is None else unzip.decompress(z)
                    runs = joined([(s["first"], s["last"]) for s in found.as_py() or ()])
                    if words:
                        runs = [(a, e) for a, e in runs if e - a >= LENGTH or len(text[a:e].split()) >= words]
                    pieces, at = [], 0
                    for a, e in runs:
                        pieces.append(text[at:a])
                        at = e
                    stay.append(b"".join([*pieces, text[at:]]))
                    sizes.append(len(text))
                    gone.append([{"first": a, "last": e} for a, e in runs])
                whole = pa.array([x.decode("utf-8", "ignore") for x in stay], pa.string()) if as_text else pa.array(stay, pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), whole, pa.array(sizes, pa.int64()), pa.array(gone, batch.schema.field("spans").type)], result.names)
            settle()

    return in_batches(src, remove, result)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def shortened(docs: DataFrame) -> DataFrame:
    """Pipeline stage: passages that stand more than once leave the texts; a cut inside a character leaves no part of it.

    A passage is a run of bytes covered by repeated strings of ``PASSAGE_BYTES``, with ``PASSAGE_WORDS`` words or ``LENGTH`` bytes
    at least: the contract's 400 bytes would miss passages of 51 to about 65 words. Every document stays, with its own columns;
    ``n_chars`` follows the text. Null texts stay null, empty ones empty.
    """
    own, back = aside(docs, "row", "z", "kept", "n_bytes", "spans", "none")
    out = dedup(own.withColumn("none", F.col("text").isNull()), length=PASSAGE_BYTES, as_text=True, words=PASSAGE_WORDS)
    text = F.when(F.col("none"), F.lit(None)).otherwise(F.col("kept"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*back)


def op1_suffix_array_dedup(spark, sf: str) -> DataFrame:
    out = dedup(table(spark, sf, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """For tests: (bytes, removed, spans, digest) of each text by counting every string."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + length]) for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        runs = joined([(i, i + length) for i in range(len(b) - length + 1) if seen[hash(b[i : i + length])] > 1])
        stay, at = b"", 0
        for a, e in runs:
            stay, at = stay + b[at:a], e
        out.append((len(b), sum(e - a for a, e in runs), len(runs), hashlib.sha256(stay + b[at:]).hexdigest()))
    return out


def passages_by_brute_force(texts: list[str | None]) -> list[str | None]:
    """For tests: each text without its repeated passages, by counting every string."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + PASSAGE_BYTES] for b in raw for i in range(len(b) - PASSAGE_BYTES + 1))
    out: list[str | None] = []
    for t, b in zip(texts, raw, strict=True):
        runs = joined([(i, i + PASSAGE_BYTES) for i in range(len(b) - PASSAGE_BYTES + 1) if seen[b[i : i + PASSAGE_BYTES]] > 1])
        stay, at = b"", 0
        for a, e in runs:
            if e - a >= LENGTH or len(b[a:e].split()) >= PASSAGE_WORDS:
                stay, at = stay + b[at:a], e
        out.append(None if t is None else (stay + b[at:]).decode("utf-8", "ignore"))
    return out

"""Benchmark decontamination: prefix-filtered join of item windows with documents.

An item's windows are its runs of ``size`` words (all its words, if it has fewer). A document
contains a window only if it contains the window's rarest word, so with words ordered by rarity a
prefix of one word is all that the join needs. The word's place in the window and both lengths say
where the window would have to start; there all words are compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import aside, byte_list, in_batches, slices, table

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Lower-cases A-Z and turns ASCII that is neither letter nor digit into spaces; bytes of other characters stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HITS = "runs array<struct<first:long,last:long>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Windows and their items, in blocks of at most about ``most`` bytes of text.

    Items stream in one partition at a time, so neither the driver nor a broadcast holds more than
    a block, however large the benchmark is.
    """
    block: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("i is not null and text is not null")
    for item, text in rows.toLocalIterator():
        w = words(text.encode())
        for start in range(max(1, len(w) - size + 1) if w else 0):
            window = tuple(w[start : start + size])
            block[window].add(item)
            held += sum(map(len, window)) + len(item)
            if held >= most:
                yield {k: sorted(v) for k, v in block.items()}
                block, held = defaultdict(set), 0
    if block:
        yield {k: sorted(v) for k, v in block.items()}


def word_counts(docs: DataFrame, vocabulary) -> dict[bytes, int]:
    """How often the words of a block occur in all documents; each task sends one row per word it met."""

    def count(batches):
        known, total = vocabulary.value, Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in byte_list(part.column("text")):
                    total.update(filter(known.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["w", "n"])

    met = in_batches(docs.select("text"), count, "w binary, n long")
    return {bytes(r[0]): r[1] for r in met.groupBy("w").agg(F.sum("n")).collect()}


def prefixes(block: dict[tuple[bytes, ...], list[str]], seen: dict[bytes, int]) -> dict[bytes, list]:
    """Rarest word of each window -> (place, window, items); windows with a word that no document has are left out."""
    index = defaultdict(list)
    for window, items in block.items():
        if all(w in seen for w in window):
            place = min(range(len(window)), key=lambda i: (seen[window[i]], window[i]))
            index[window[place]].append((place, window, items))
    return dict(index)


def probe(w: list[bytes], index: dict[bytes, list]) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of words inside windows (may overlap), and the items met."""
    runs, items = [], set()
    if index.keys().isdisjoint(w):
        return runs, items
    for at, word in enumerate(w):
        for place, window, owners in index.get(word, ()):
            start = at - place
            if start >= 0 and start + len(window) <= len(w) and tuple(w[start : start + len(window)]) == window:
                runs.append((start, start + len(window)))
                items.update(owners)
    return runs, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, merged hit ``runs`` (word places) and ``items``.

    ``docs`` needs ``text``; other columns pass unchanged unless they are named like the three results.
    Null and empty texts have no words and no hits; null items and null item ids are passed over; items of
    the same id count once; windows shared by items hit all of them. An empty benchmark hits nothing.
    Documents are read in place: no shuffle, so no word or source can be hot.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "items")]
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), *(F.from_json(F.lit("[]"), t).alias(n) for n, t in (x.split(" ", 1) for x in HITS.split(", "))))
    schema = out.schema
    blocks = item_blocks(benchmark, size, block_bytes)
    block = next(blocks, {})
    while block is not None:
        vocabulary = spark.sparkContext.broadcast({w for window in block for w in window})
        seen = word_counts(docs, vocabulary) if block else {}
        vocabulary.unpersist()
        index = spark.sparkContext.broadcast(prefixes(block, seen))

        def mark(batches, index=index):
            met = index.value
            for batch in batches:
                for part in slices(batch, "text"):
                    n, runs, items = [], [], []
                    for text, r, i in zip(byte_list(part.column("text")), part.column("runs").to_pylist(), part.column("items").to_pylist(), strict=True):
                        w = words(text)
                        new_runs, new_items = probe(w, met)
                        n.append(len(w))
                        runs.append([{"first": a, "last": b} for a, b in merged(new_runs + [(x["first"], x["last"]) for x in r])])
                        items.append(sorted(new_items.union(i)))
                    arrays = {name: part.column(name) for name in kept} | {"n_words": pa.array(n, pa.int64()), "runs": pa.array(runs, part.schema.field("runs").type), "items": pa.array(items, part.schema.field("items").type)}
                    yield pa.RecordBatch.from_arrays([arrays[name] for name in part.schema.names], part.schema.names)

        out = in_batches(out, mark, schema)
        block = next(blocks, None)
    return out


def digest(marked: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op9_benchmark_decontamination(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = contamination(docs, table(spark, sf, "benchmark"))
    return digest(marked.drop("text"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own, back = aside(docs, "n_words", "runs", "items")
    marked = contamination(own, benchmark)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return marked.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select(*back)


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], size: int = WINDOW):
    """For tests: (n_words, n_hit, item ids) of each text by plain comparison."""
    out = []
    windows = []
    for item, text in items:
        w = words((text or "").encode())
        if item is not None and w:
            windows += [(str(item), w[s : s + size]) for s in range(max(1, len(w) - size + 1))]
    for text in texts:
        w = words((text or "").encode())
        hit, met = set(), set()
        for item, window in windows:
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    met.add(item)
        out.append((len(w), len(hit), sorted(met)))
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)),
hits AS (SELECT dw.r, dw.s, dw.n, bw.item FROM dw JOIN bw USING (n, win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(p) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

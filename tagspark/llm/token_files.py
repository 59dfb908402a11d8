"""Token-id files: each document compressed alone with one shared dictionary, found through an offset index.

A file set is a Parquet folder of blocks. A block holds up to ``BLOCK`` bytes of zstandard frames, one
for each document, side by side in ``blob``, and its index: ids of the documents, where each frame
starts (``offsets``, one more than documents), how many ids it holds. ``shard`` and ``block`` give the
order; ``dict_hash`` names the dictionary, which a folder beside it keeps. Ids are little-endian, two
bytes wide if the vocabulary allows it. Spark writes and commits the files, so a lost task leaves none behind.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, shared_dir, slices, table, text_list
from tagspark.llm.pretok import encoder

END = 2
BLOCK = 4 << 20
DICTIONARY = 64 << 10
#: Documents that the dictionary is trained on at most, about, and how long they may be.
TRAIN_DOCS, TRAIN_CHARS = 600, 20_000
BLOCKS = "shard int, block long, before long, dict_hash string, width int, doc_ids array<long>, offsets array<long>, n_tokens array<long>, blob binary"


def serialized(ids: np.ndarray, end: int, width: int) -> bytes:
    return np.append(ids, end).astype(f"<u{width}").tobytes()


def trained(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """A dictionary from the serialized ids of a sample chosen by hash; empty if there is too little text.

    The dictionary only changes sizes of files, never the ids read back.
    """
    n = docs.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("dictionary")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where((place < min(1.0, TRAIN_DOCS / max(n, 1))) & (F.length("text") <= TRAIN_CHARS)).select("text").limit(4 * TRAIN_DOCS)
    texts = [r[0] for r in sample.collect()]
    arrays = [serialized(ids, end, width) for ids in encoder(path).encode(texts)]
    if sum(map(len, arrays)) < 32 * 1024 or len(arrays) < 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, arrays)) // 8), arrays).as_bytes()
    except zstandard.ZstdError:  # samples too alike to learn from
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_ids(docs: DataFrame, path: str, folder: str, end: int = END, block: int = BLOCK, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text; null text: empty) into ``folder`` in ascending doc_id order.

    Rows are dealt by ranges of doc_id and sorted inside a task; rows of the same id are ordered by
    their text, rows without an id come first. Every document gets ``end`` after its ids.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    width = 2 if max(encoder(path).tok.get_vocab_size(), end + 1) <= 1 << 16 else 4
    raw = trained(rows, path, end, width)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = spark.sparkContext.broadcast(raw)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        enc, shard = encoder(path), TaskContext.get().partitionId()
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(sent.value), write_content_size=True)
        ids, counts, frames, held, number, before = [], [], [], 0, 0, 0

        def out():
            nonlocal ids, counts, frames, held, number, before
            offsets = np.r_[0, np.cumsum([len(x) for x in frames])].tolist()
            row = {"shard": [shard], "block": [number], "before": [before], "dict_hash": [digest], "width": [width], "doc_ids": [ids], "offsets": [offsets], "n_tokens": [counts], "blob": [b"".join(frames)]}
            types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            before += sum(counts)
            number += 1
            ids, counts, frames, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, got in zip(part.column("doc_id").to_pylist(), enc.encode(text_list(part.column("text"))), strict=True):
                    frame = zip_.compress(serialized(got, end, width))
                    ids.append(doc), counts.append(len(got) + 1), frames.append(frame)
                    held += len(frame)
                    if held >= block:
                        yield out()
        if ids:
            yield out()

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    in_batches(ordered, pack, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def _starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: as many rows as there were tasks."""
    sums = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    rows, total = [], 0
    for shard, n in sums:
        rows.append((shard, total))
        total += n
    return blocks.sparkSession.createDataFrame(rows, "shard int, earlier long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of a file set: doc_id, start, n_tokens, ids (little-endian, four bytes each).

    The hash of the dictionary that a block names is checked against the stored one.
    """
    raw = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    sent = spark.sparkContext.broadcast(raw)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    placed = blocks.join(F.broadcast(_starts(blocks)), "shard").select((F.col("before") + F.col("earlier")).alias("start"), "dict_hash", "width", "doc_ids", "offsets", "n_tokens", "blob")

    def unpack(batches):
        zip_ = zstandard.ZstdDecompressor(dict_data=_dictionary(sent.value))
        digest = hashlib.sha256(sent.value).hexdigest()
        for batch in batches:
            for row in range(batch.num_rows):
                b = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                if b["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                blob, offsets, counts = memoryview(b["blob"]), b["offsets"], b["n_tokens"]
                starts = (b["start"] + np.cumsum(counts) - counts).tolist()
                for lo in range(0, len(counts), 500):
                    hi = min(lo + 500, len(counts))
                    ids = [np.frombuffer(zip_.decompress(blob[offsets[i] : offsets[i + 1]]), f"<u{b['width']}").astype("<u4").tobytes() for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"][lo:hi], pa.int64()), pa.array(starts[lo:hi], pa.int64()), pa.array(counts[lo:hi], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return in_batches(placed, unpack, "doc_id long, start long, n_tokens long, ids binary")


def one_document(spark: SparkSession, folder: str, doc_id: int) -> list[int] | None:
    """Ids of one document: only blocks that list it are read, and of them only its frame is decompressed."""
    found = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if found is None:
        return None
    raw = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    i = found.doc_ids.index(doc_id)
    frame = bytes(found.blob[found.offsets[i] : found.offsets[i + 1]])
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress(frame), f"<u{found.width}").tolist()


def op3_token_files(spark, sf: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Quality by compression: a dictionary of good and one of bad text, and which of them shortens a text more.

The difference of the two compressed sizes, as a share of the text's own size, and the sizes
themselves become a score through a logistic curve fitted on labelled texts that neither dictionary saw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import bounded_sample, byte_list, crc_bucket, in_batches, keep, logistic, probability, slices, table

#: Bound of the labelled rows used, for each label; half build the dictionaries, half fit the curve.
PER_LABEL = 2400
DICTIONARY = 112 << 10
#: Bytes of a piece that a dictionary learns from; texts are cut into such pieces.
PIECE = 64 << 10
THRESHOLD = 0.3


class Sizes:
    """Sizes of a text compressed with each dictionary and with none, turned into features."""

    def __init__(self, good: bytes, bad: bytes):
        make = lambda raw: zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.good, self.bad, self.plain = make(good), make(bad), make(b"")

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 6))
        for i, t in enumerate(texts):
            good, bad, plain, n = len(self.good.compress(t)), len(self.bad.compress(t)), len(self.plain.compress(t)), len(t) + 32
            out[i] = (bad - good) / n, (bad - good) / (bad + good + 1), good / n, bad / n, plain / n, np.log(n)
        return out


def dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes() if len(texts) >= 8 else b"".join(texts)[:DICTIONARY]
    except zstandard.ZstdError:  # too little text to train on: the texts themselves serve
        return b"".join(texts)[:DICTIONARY]


def _pieces(sample: DataFrame) -> list[tuple[int, bytes]]:
    """(label, bytes) of the whole sampled texts in pieces of ``PIECE`` bytes; of more than ``PER_LABEL`` pieces a label, about as many
    by a hash of text and place."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = [(y, t[i : i + PIECE], i) for t, y in zip(byte_list(part.column("text")), part.column("label").to_pylist(), strict=True) for i in range(0, len(t), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], ["label", "piece", "at"])

    pieces = in_batches(sample.select("text", "label"), cut, "label int, piece binary, at long").withColumn("doc_id", F.xxhash64("piece", "at"))
    return sorted((r.label, bytes(r.piece)) for r in bounded_sample(pieces, "label", PER_LABEL, "piece").collect())


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Both dictionaries and the curve from ``docs`` (doc_id, text) and ``labels`` (doc_id, label); None without two labels.

    At most about ``PER_LABEL`` rows a label are used, chosen by a hash of the id before any text is read;
    only these few ids are sent to the scan of the texts. Half of them build the dictionaries, half, whole, fit the curve.
    """
    labels = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = F.broadcast(bounded_sample(labels, "label", PER_LABEL, "quality"))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")
    sample = keep(sample.withColumn("learns", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0), "quality-sample")
    learnt = _pieces(sample.where("learns"))
    good, bad = (dictionary([p for label, p in learnt if label == y]) if any(label == y for label, _ in learnt) else None for y in (1, 0))
    if good is None or bad is None:
        return None
    sent = sample.sparkSession.sparkContext.broadcast((good, bad))

    def features(batches):
        sizes = Sizes(*sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                x = sizes.features(byte_list(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("label").cast(pa.float64())], ["x", "y"])

    got = in_batches(sample.where("not learns"), features, "x array<double>, y double").collect()
    if len({r.y for r in got}) < 2:
        return None
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / spread
    # the sample holds the labels in equal parts; the intercept is moved back to their true odds
    w = logistic(np.c_[z, z[:, :5] ** 2], y)
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    w[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return {"good": good, "bad": bad, "mean": mean, "spread": spread, "w": w}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` with ``score``, reading ``text`` alone; null counts as empty.

    Without a model every score is 0.5. A column of ``docs`` named ``score`` is replaced.
    """
    kept = [c for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*kept, F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*kept)
    schema = src.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        m = sent.value
        sizes = Sizes(m["good"], m["bad"])
        for batch in batches:
            for part in slices(batch, "text"):
                z = (sizes.features(byte_list(part.column("text"))) - m["mean"]) / m["spread"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(probability(np.c_[z, z[:, :5] ** 2], m["w"]))], schema.names)

    return in_batches(src, run, schema)


def op6_quality(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    bucket = crc_bucket(F.col("doc_id"), 5)
    model = fit(docs, labels.where(bucket != 0))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(bucket == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

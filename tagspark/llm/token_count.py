"""Token counts: pre-tokens that are one token are counted directly, only the rest is merged."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.llm.common import in_batches, slices, table, text_list
from tagspark.llm.pretok import Encoder, whole_tokens

LIMIT = 2048


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``, in place: no shuffle.

    The single-token strings are proven once, on the driver, and sent to the tasks (as many as the
    vocabulary has at most). Null and empty texts have no bytes and no tokens. Special strings in a text are
    taken as the library's default takes them. Columns of ``docs`` named like the two results are replaced.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    src = docs.select(*kept)
    schema = src.withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def count(batches):
        enc = Shortcut(path, proven.value)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                arrays = [part.column(c) for c in kept] + [sizes, pa.array(enc.counts(text_list(part.column("text"))), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return in_batches(src, count, schema)


class Shortcut(Encoder):
    """An encoder that starts, and starts anew, with the proven strings."""

    def __init__(self, path: str, proven: dict[str, int]):
        self.proven = {}
        super().__init__(path)
        self.proven = proven
        self.preload(proven)

    def forget(self) -> None:
        super().forget()
        self.preload(self.proven)


def op2_token_count(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)

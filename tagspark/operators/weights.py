"""Weighted terms as sparse vectors: a vocabulary counted by tasks, held as flat arrays.

Tasks count the terms of their rows, so that a row for each term leaves them, and the driver gets the terms that stay, once, as Arrow
arrays: a term costs it its letters and a few bytes. Vectors are made where the rows lie.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.operators.linear import FEATURES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Terms that are written at a time.
_WRITTEN = 500_000
#: Tokens of a batch that are looked up at a time.
_TOKENS = 4_000_000


def _pairs(lists):
    """The distinct words of lists of tokens, and for each pair of row and word that occurs the row, the word's place and how often it stands."""
    import pyarrow as pa
    import pyarrow.compute as pc

    row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64))
    words = pc.dictionary_encode(pc.list_flatten(lists))
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    codes = words.indices
    if codes.null_count:
        row, codes = row[np.asarray(codes.is_valid())], codes.drop_null()
    size = max(1, len(words.dictionary))
    found, n = np.unique(row * size + np.asarray(codes).astype(np.int64), return_counts=True)
    return words.dictionary, found // size, found % size, n


def _slices(column):
    """Parts of a column of lists with about ``_TOKENS`` tokens each, and where they begin."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _TOKENS, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


@dataclass
class TermPart:
    """The terms of one column of tokens in the order of their places, the most frequent first, and their weights."""

    column: str
    terms: object  # a pyarrow array of strings
    weights: np.ndarray

    @property
    def vocabulary(self) -> list[str]:
        return self.terms.to_pylist()

    @property
    def size(self) -> int:
        return len(self.terms)


def fit_terms(tokens: DataFrame, column: str, min_df: int, n: int) -> TermPart:
    """Terms that stand in at least ``min_df`` of the ``n`` rows, with smoothed idf plus one."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                words, _, code, times = _pairs(part)
                tf, df = np.bincount(code, times, len(words)).astype(np.int64), np.bincount(code, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(tf), pa.array(df)], ["term", "tf", "df"])

    counts = tokens.select(column).mapInArrow(count, "term string, tf long, df long")
    known = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    rows = known.orderBy(F.desc("tf"), "term").select("term", F.col("df").cast("int").alias("df")).toArrow().combine_chunks()
    if not rows.num_rows:
        raise ValueError("no term stands in min_df records: the vocabulary is empty")
    terms = pa.concat_arrays(rows["term"].chunks) if rows["term"].num_chunks != 1 else rows["term"].chunk(0)
    return TermPart(column, terms, np.log((n + 1.0) / (rows["df"].to_numpy() + 1.0)) + 1.0)


@dataclass
class TermVectors:
    """Vectors of weighted terms: each part's scaled to length 1 by itself, then side by side."""

    parts: list[TermPart]
    _shared: object = field(default=None, repr=False, compare=False)

    @property
    def stages(self) -> list[TermPart]:
        return self.parts

    @property
    def size(self) -> int:
        return sum(p.size for p in self.parts)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the column ``features``."""
        if self._shared is None:
            self._shared = rows.sparkSession.sparkContext.broadcast([(p.terms, p.weights) for p in self.parts])
        shared, columns, size = self._shared, [p.column for p in self.parts], self.size

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            def vectors(lists):
                """Index, value and lengths of the vectors of some rows, whose lists of tokens are given for each part."""
                keys, values, start = [], [], 0
                for column, (terms, weights) in zip(lists, shared.value, strict=True):
                    words, row, code, n = _pairs(column)
                    place = np.asarray(pc.fill_null(pc.index_in(words.cast(terms.type), value_set=terms), -1))[code]
                    at = place >= 0
                    row, place, raw = row[at], place[at].astype(np.int64), n[at] * weights[place[at]]
                    length = np.sqrt(np.bincount(row, raw * raw, len(column)))
                    keys.append(row * size + start + place)
                    values.append(raw / length[row])
                    start += len(terms)
                keys, values = np.concatenate(keys), np.concatenate(values)
                order = np.argsort(keys)
                keys = keys[order]
                return (keys % size).astype(np.int32), values[order], np.bincount(keys // size, minlength=len(lists[0]))

            for batch in batches:
                own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                for start, first in _slices(own[0]):
                    lists = [first, *(x.slice(start, len(first)) for x in own[1:])]
                    index, value, lengths = vectors(lists)
                    ends, n = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), len(first)
                    cells = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(index)), pa.ListArray.from_arrays(ends, pa.array(value))
                    made = pa.StructArray.from_arrays(cells, ["type", "size", "indices", "values"])
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, n).columns, made], [*batch.schema.names, FEATURES])

        return rows.mapInArrow(run, type(rows.schema)(rows.schema.fields[:]).add(FEATURES, VectorUDT()))

    def places(self, terms: Sequence[str]) -> dict[str, int]:
        """Places of some terms among the first part's."""
        import pyarrow as pa
        import pyarrow.compute as pc

        asked = pa.array(list(dict.fromkeys(terms)), self.parts[0].terms.type)
        found = pc.index_in(asked, value_set=self.parts[0].terms).to_pylist()
        return {t: p for t, p in zip(asked.to_pylist(), found, strict=True) if p is not None}

    def save(self, spark: SparkSession, path: str) -> None:
        import pyarrow as pa

        for i, p in enumerate(self.parts):
            for start in range(0, p.size, _WRITTEN):
                terms, weights = p.terms.slice(start, _WRITTEN), p.weights[start : start + _WRITTEN]
                cells = pa.array(np.full(len(terms), i, np.int32)), pa.array([p.column] * len(terms)), pa.array(np.arange(start, start + len(terms), dtype=np.int32)), terms, pa.array(weights)
                rows = spark.createDataFrame(pa.Table.from_arrays(cells, ["part", "column", "place", "term", "weight"]))
                rows.write.mode("append" if i or start else "overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TermVectors:
        import pyarrow as pa

        rows = spark.read.parquet(path)
        parts = []
        for r in rows.select("part", "column").distinct().orderBy("part").collect():
            own = rows.where(F.col("part") == r["part"]).orderBy("place").select("term", "weight").toArrow()
            parts.append(TermPart(r["column"], pa.concat_arrays(own["term"].chunks), own["weight"].to_numpy()))
        return TermVectors(parts)

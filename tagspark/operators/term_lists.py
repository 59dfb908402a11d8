"""Terms of a record in one list: counted and weighted without a row per record and term being sorted or sent.

A part's records (see ``joins.in_parts``) and the numbers of records that hold its terms meet in one task, where Arrow lists are counted;
a part has to fit into a task's memory, so more data wants more shuffle partitions, as it does elsewhere.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspark.functions.codes import explode_rows
from tagspark.operators.joins import PART, answers_to_parts, in_parts

# Ship the helpers below with each task: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The column that says which share of all terms a row holds.
SHARE = "_share"
_COUNTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())]))


def _pairs(part, between=None):
    """Of the rows (part, id, tokens) of a part: its ids, its words, and for each pair of id and word their places and how often the word stands.

    Tokens are a list, or, with ``between``, one text in which that sign stands between them; the empty text has none.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    part = part.combine_chunks()
    lists = part.column(2)
    if between is not None:
        lists = pc.split_pattern(pc.if_else(pc.equal(lists, ""), pa.scalar(None, lists.type), lists), between)
    ids = pc.dictionary_encode(part.column(1), null_encoding="encode").combine_chunks()
    row = np.repeat(np.asarray(ids.indices).astype(np.int64), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    words = pc.dictionary_encode(pc.list_flatten(lists)).combine_chunks()
    codes = words.indices
    if codes.null_count:
        row = row[np.asarray(codes.is_valid())]
        codes = codes.drop_null()
    size = max(1, len(words.dictionary))
    found, tf = np.unique(row * size + np.asarray(codes).astype(np.int64), return_counts=True)
    return ids.dictionary, words.dictionary, found // size, found % size, tf


def _cells(bounds, terms, **numbers):
    """Columns of binary cells, cell i with the entries ``bounds[i]`` to ``bounds[i + 1]``: the terms' bytes one after the other, their
    sizes, and numbers beside them."""
    import pyarrow as pa

    terms = pa.concat_arrays([terms.cast(pa.string())])  # its own buffers, from their beginning
    ends = np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1] if len(terms) else np.zeros(1, np.int32)

    def cells(at, data):
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at.astype(np.int32)), data])

    out = {"words": cells(ends[bounds], terms.buffers()[2] or pa.py_buffer(b""))}
    for name, values in {"sizes": np.diff(ends).astype(np.int32), **numbers}.items():
        out[name] = cells(bounds * values.itemsize, pa.py_buffer(np.ascontiguousarray(values)))
    return out


def _numbers(column, kind):
    """The numbers in all binary cells of a column, one after the other, and how many of them each cell holds."""
    import pyarrow as pa

    cells = pa.concat_arrays([pa.array([], pa.binary()), *(c.cast(pa.binary()) for c in column.chunks)])
    data = cells.buffers()[2]
    ends = np.frombuffer(cells.buffers()[1], np.int32)[: len(cells) + 1] if len(cells) else np.zeros(1, np.int32)
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _terms(packed):
    """The terms in the cells that :func:`_cells` made, and how many of them each row holds."""
    import pyarrow as pa

    sizes, held = _numbers(packed["sizes"], np.int32)
    ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32)
    data = np.ascontiguousarray(_numbers(packed["words"], np.uint8)[0])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data)), held


def _shares(terms, shares):
    """The share of each term, by a hash of its bytes."""
    import pyarrow as pa

    terms = pa.concat_arrays([terms.cast(pa.string())])
    if not len(terms):
        return np.zeros(0, np.int32)
    ends = np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[: ends[-1]]
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    powers = np.cumprod(np.full(int(np.diff(ends).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(powers[place] * (data + np.uint64(1)))]
    mixed = (sums[ends[1:]] - sums[ends[:-1]]) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(shares)).astype(np.int32)


def _vocabulary(key, part, shares, between=None):
    """(share, part, words, sizes, n): in how many of a part's records each of its terms stands; a row holds all terms of a share."""
    import pyarrow as pa

    _, terms, _, code, _ = _pairs(part, between)
    n = np.bincount(code, minlength=len(terms)).astype(np.int64)
    share = _shares(terms, shares)
    order = np.argsort(share, kind="stable")
    own, starts = np.unique(share[order], return_index=True)
    cells = _cells(np.r_[starts, len(order)], terms.take(pa.array(order)), n=n[order])
    return pa.table({SHARE: pa.array(own), PART: pa.array(np.full(len(own), key[0].as_py(), np.int32)), **cells})


def _found(packed, min_df):
    """Of the rows (share, part, words, sizes, n) of a share: the terms that stand in ``min_df`` records at least, once for each part
    that holds them, the number of those records, and where each row's terms begin and end."""
    import pyarrow.compute as pc

    terms, held = _terms(packed)
    words = pc.dictionary_encode(terms)
    code = np.asarray(words.indices)
    n = _numbers(packed["n"], np.int64)[0]
    df = np.zeros(len(words.dictionary), np.int64)
    np.add.at(df, code, n)
    df = df[code]
    keep = df >= min_df
    kept = np.bincount(np.repeat(np.arange(len(held)), held)[keep], minlength=len(held))
    return terms.filter(keep), df[keep], np.r_[0, np.cumsum(kept)].astype(np.int64)


def _counted(part, answers, between=None):
    """The records of a part (part, id, tokens) with the list of their terms that are among the answers (part, words, sizes, df)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, terms, row, code, tf = _pairs(part, between)
    place = np.asarray(pc.index_in(terms, value_set=_terms(answers)[0]).fill_null(-1))[code]
    at = place >= 0
    row, code, tf, df = row[at], code[at], tf[at], _numbers(answers["df"], np.int64)[0][place[at]]
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))].astype(np.int32)
    each = pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf.astype(np.int64)), pa.array(df.astype(np.int64))], ["term", "tf", "df"])
    return pa.table({"id": ids, "terms": pa.ListArray.from_arrays(pa.array(ends), each)}).filter(pa.array(np.diff(ends) > 0))


def _asked(df: DataFrame, tokens_col: str, id: str, between: str | None) -> tuple[DataFrame, DataFrame, int]:
    """The records (part, id, tokens) in parts; for each part and share of all terms a row (share, part, words, sizes, n); the number of shares."""
    tokens = F.col(tokens_col) if between is None else F.array_join(tokens_col, between)
    lists = in_parts(df.select(F.col(id).alias("id"), tokens.alias("_tokens")), "id").select(PART, "id", "_tokens")
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def vocabulary(key, part):
        return _vocabulary(key, part, shares, between)

    # both uses read all columns, so that the lists are made and sent once
    own = lists.groupBy(PART).applyInArrow(vocabulary, f"{SHARE} int, {PART} int, words binary, sizes binary, n binary")
    # a term stands in as many rows as there are parts at most
    return lists, own, shares


def term_lists(df: DataFrame, tokens_col: str, min_df: int = 1, id: str = "org_id", between: str | None = None) -> DataFrame:
    """``(id, terms)``: each record that holds one with its list of ``(term, tf, df)``, of terms found in at least ``min_df`` records.

    Rows of one id are one record. The lists of tokens travel once; after that, only the vocabulary of each part does, a share of it in
    a row. With ``between``, a sign that no token holds, lists of tokens that are not empty travel as one text each.
    """
    lists, own, _ = _asked(df, tokens_col, id, between)

    def known(packed):
        import pyarrow as pa

        terms, n, bounds = _found(packed, min_df)
        return pa.table({PART: packed[PART], **_cells(bounds, terms, df=n)})

    def counted(part, answers):
        return _counted(part, answers, between)

    answers = answers_to_parts(own.groupBy(SHARE).applyInArrow(known, f"{PART} int, words binary, sizes binary, df binary"))
    kinds = T.StructType([T.StructField("id", df.schema[id].dataType), T.StructField("terms", _COUNTED)])
    made = lists.groupBy(PART).cogroup(answers.groupBy(PART)).applyInArrow(counted, kinds)
    return made.select(F.col("id").alias(id), "terms")


def _weighed(part, answers, between=None):
    """(id, term, weight): of the records of a part (part, id, tokens), the weights of the wanted terms among the answers
    (part, words, sizes, idf, wanted), scaled by all terms of the answers."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, terms, row, code, tf = _pairs(part, between)
    place = np.asarray(pc.index_in(terms, value_set=_terms(answers)[0]).fill_null(-1))[code]
    at = place >= 0
    row, code, place = row[at], code[at], place[at]
    raw = tf[at] * _numbers(answers["idf"], np.float64)[0][place]
    length = np.sqrt(np.bincount(row, raw * raw, minlength=len(ids)))
    at = _numbers(answers["wanted"], np.bool_)[0][place]
    columns = ids.take(pa.array(row[at])), terms.take(pa.array(code[at])), pa.array(raw[at] / length[row[at]])
    return pa.table(dict(zip(("id", "term", "weight"), columns, strict=True)))


def wanted_weights(
    df: DataFrame, tokens_col: str, n_records: DataFrame, wanted: DataFrame, min_df: int = 1, id: str = "org_id", between: str | None = None
) -> DataFrame:
    """``(id, term, weight)``: the weights that :func:`weights_of` gives, of the ``wanted`` terms (``term``) only; the other terms of a
    record count for its length and go no further than the task that counts them. ``between`` is that of :func:`term_lists`."""
    lists, own, shares = _asked(df, tokens_col, id, between)

    def shared(batches):
        import pyarrow as pa

        for batch in batches:
            terms = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(_shares(terms, shares)), terms], [SHARE, "term"])

    asked = wanted.select("term").where(F.col("term").isNotNull()).distinct()
    asked = asked.mapInArrow(shared, f"{SHARE} int, term string")

    def known(packed, asked):
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, n, bounds = _found(packed, min_df)
        total = np.asarray(packed["_n"])[0] if len(packed) else 1.0
        held = np.asarray(pc.is_in(terms, value_set=asked["term"].combine_chunks()))
        return pa.table({PART: packed[PART], **_cells(bounds, terms, idf=np.log(total / (1.0 + n)) + 1.0, wanted=held)})

    def weighed(part, answers):
        return _weighed(part, answers, between)

    numbered = own.withColumn("_n", F.lit(1.0) + n_records.scalar())
    made = numbered.groupBy(SHARE).cogroup(asked.groupBy(SHARE)).applyInArrow(known, f"{PART} int, words binary, sizes binary, idf binary, wanted binary")
    kinds = T.StructType([T.StructField("id", df.schema[id].dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    weights = lists.groupBy(PART).cogroup(answers_to_parts(made).groupBy(PART)).applyInArrow(weighed, kinds)
    return weights.select(F.col("id").alias(id), "term", "weight")


def weights_of(lists: DataFrame, n_records: DataFrame, id: str = "org_id") -> DataFrame:
    """``(id, term, weight)``: the weights of ``features.tfidf_l2``, scaled to length 1 where the list lies."""
    # a lambda may not hold a subquery, so the number becomes a column
    numbered = lists.withColumn("_n", F.lit(1.0) + n_records.scalar())
    raw = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["tf"] * (F.log(F.col("_n") / (F.lit(1.0) + t["df"])) + 1.0)).alias("raw")))
    length = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, t: a + t["raw"] * t["raw"]))
    rows = numbered.select(id, raw.alias("_raw")).withColumn("_length", length)
    return explode_rows(rows, [id, "_length"], "_raw", "_t").select(id, F.col("_t.term").alias("term"), (F.col("_t.raw") / F.col("_length")).alias("weight"))

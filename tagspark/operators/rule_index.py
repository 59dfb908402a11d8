"""Rules by the thousand: an index from words to rules, candidates by join, and only these are tried.

Every rule is read for letters that a match cannot do without (``functions/patterns.py``). Those that are a whole word go into
the index as they are; beginnings, endings and inner parts are looked up, by their rarest three letters, among the distinct words of
the texts. A text's words then meet the index, and each text carries the few rules that may hold, as values, into one
filter that tries them. The plan has the same size for ten rules and for ten thousand.

Rules of plain ASCII words, or of their beginnings, endings or inner parts, are settled by the words alone: no pattern is tried for them. Texts lie in
parts (see ``joins.in_parts``), each part asks once for each of its words, and what holds is put together there.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspark import fixed
from tagspark.functions import patterns
from tagspark.functions.codes import code_set
from tagspark.operators.joins import PART, answers_to_parts, in_parts
from tagspark.session import keep_table, release

# Executors need not have this package for the functions that run there.
cloudpickle.register_pickle_by_value(patterns)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Case-insensitive, with Unicode letters, digits and word edges.
FLAGS = "(?iU)"
#: Words of the index that are broadcast at a time.
BLOCK_WORDS = 500_000
_PIECES = "rule long, use string, letters string, begins boolean, ends boolean"
#: Texts of a part whose words are put together at a time.
_TEXTS = 2_000


def letter_words(corpus: Column) -> Column:
    """The runs of letters of a text, each once, folded at least as far as a pattern ignores case."""
    runs = F.regexp_extract_all(corpus, F.lit(r"(\p{L}+)"), F.lit(1))
    # the dotted I folds to i; that also keeps the two case changes from being taken for one
    return F.array_distinct(F.transform(runs, lambda w: F.lower(F.translate(F.upper(w), "İ", "I"))))


def folded_ascii(corpus: Column) -> Column:
    """The text with ASCII letters in lower case, and so whatever else a pattern that ignores case takes for one."""
    odd = "\u0130\u0131\u017f\u212a"  # the dotted and the dotless i, the long s, the Kelvin sign
    return F.lower(F.when(reduce(or_, [F.contains(corpus, F.lit(c)) for c in odd]), F.translate(corpus, odd, "iisk")).otherwise(corpus))


def plain_words(corpus: Column) -> Column:
    """The runs of letters, digits and ``_`` of a text, each once, folded as a pattern folds ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(folded_ascii(corpus), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def _threes(word: Column) -> Column:
    starts = F.when(F.char_length(word) >= 3, F.sequence(F.lit(1), F.char_length(word) - 2))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(3))))


def _pieces(rules: DataFrame) -> DataFrame:
    """The pieces of each rule, one of which its texts hold. A rule of plain words has its pieces as ``plain``, and those of its
    exclude, once for all rules that share it, as ``shut``; any other has ``open`` ones, one without letters if it may hold anywhere."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for rule, code, include, exclude, shut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plain, stop = patterns.plain_pieces(include) if code is not None else None, patterns.plain_pieces(exclude)
                if plain and (stop or exclude is None):
                    found = [("plain", p) for p in plain]
                else:
                    found = [("open", p) for p in patterns.required_pieces(include) or (None,)]
                found += [("shut", p) for p in stop or () if rule == shut]
                out += [(rule, use, p.letters, p.begins, p.ends) if p else (rule, use, None, None, None) for use, p in found]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rule", "use", "letters", "begins", "ends"])

    return rules.select("rule", "code", "include", "exclude", "shut").mapInArrow(run, _PIECES)


def _words_of(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, use, rule) for every distinct word that holds a piece where it must."""
    grams = keep_table(vocabulary.select("word", F.explode(_threes(F.col("word"))).alias("gram")), "grams")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = parts.select("letters", F.explode(_threes(F.col("letters"))).alias("gram")).distinct()
    # three letters that no word holds rule their piece out; the join must not lose them, so they count 0
    keys = own.join(counts, "gram", "left").groupBy("letters").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    wanted = parts.join(keys, "letters")
    near = grams.join(wanted, "gram")
    word, letters = F.col("word"), F.col("letters")
    holds = F.when(F.col("begins"), F.startswith(word, letters)).when(F.col("ends"), F.endswith(word, letters)).otherwise(F.contains(word, letters))
    return near.where(holds).select("word", "use", "rule")


@dataclass
class RuleIndex:
    """Rules (rule, code, include, exclude, shut), the words that call for them (word, rules), and how many words there are; what plain words
    settle (word, calls, stops): codes with the number of their exclude, and excludes that the word is found by."""

    rules: DataFrame
    words: DataFrame
    anywhere: DataFrame
    n_words: int
    plain: DataFrame

    def release(self) -> None:
        """Remove the index's files; tags made with it must have been written before."""
        release(self.rules, self.words, self.anywhere, self.plain)


def _found(pieces: DataFrame, words: Column, texts: DataFrame) -> DataFrame:
    """(word, use, rule): the words that hold a piece, among the distinct ones of the texts."""
    whole = F.col("begins") & F.col("ends")
    found = pieces.where(whole).select(F.col("letters").alias("word"), "use", "rule")
    parts = pieces.where(~whole)
    if not parts.isEmpty():
        found = found.unionByName(_words_of(parts, texts.select(F.explode(words).alias("word")).distinct()))
    return found


def build_index(texts: DataFrame, rules: DataFrame, corpus: str = "corpus") -> RuleIndex:
    """An index of ``rules`` (code, include, exclude) for ``texts``; rules without a pattern are passed over.

    It serves the texts that it was made for: words found nowhere in them are not in it.
    """
    stated = F.coalesce((F.col("include") != "") & (F.col("include") != fixed.EMPTY_RULE), F.lit(False))
    blank = F.coalesce(F.col("exclude").isin("", fixed.EMPTY_RULE), F.lit(True))
    listed = rules.where(stated).select("code", "include", F.when(~blank, F.col("exclude")).alias("exclude")).distinct()
    listed = keep_table(listed.withColumn("rule", F.monotonically_increasing_id()), "rules")
    shared = listed.where("exclude is not null").groupBy("exclude").agg(F.min("rule").alias("shut"))
    pieces = keep_table(_pieces(listed.join(shared, "exclude", "left")), "pieces")
    found = _found(pieces.where("use = 'open'"), letter_words(F.col(corpus)), texts)
    words = keep_table(found.groupBy("word").agg(F.array_sort(F.collect_set("rule")).alias("rules")), "rule-words")
    anywhere = keep_table(pieces.where("letters is null").select("rule").join(listed, "rule"), "rules-anywhere")
    settled = _found(pieces.where("use != 'open'"), plain_words(F.col(corpus)), texts).join(listed.join(shared, "exclude", "left"), "rule")
    call = F.when(F.col("use") == "plain", F.struct("code", F.coalesce("shut", F.lit(-1)).alias("shut")))
    stop = F.when(F.col("use") == "shut", F.col("rule"))
    plain = keep_table(settled.groupBy("word").agg(F.collect_set(call).alias("calls"), F.collect_set(stop).alias("stops")), "plain-words")
    return RuleIndex(listed, words, anywhere, words.count(), plain)


def _asked(key, part):
    """(part, word): the words of a part's texts, each once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.unique(pc.list_flatten(part.column("_plain")))
    return pa.table({PART: pa.array(np.full(len(words), key[0].as_py(), np.int32)), "word": words})


def _lists(column):
    """Starts, lengths and items of a column of lists."""
    import pyarrow.compute as pc

    flat = pc.list_flatten(column).combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.cumsum(lengths) - lengths, lengths, flat


def _drawn(place, starts, lengths):
    """For lists asked for by ``place``: which of the askers each item goes to, and where the item stands."""
    n = lengths[place]
    asker = np.repeat(np.arange(len(place)), n)
    return asker, np.arange(len(asker)) - np.repeat(np.cumsum(n) - n, n) + starts[place][asker]


def _settled(part, answers):
    """The rows of a part with the sorted codes that their words call for and no word of theirs stops."""
    import pyarrow as pa
    import pyarrow.compute as pc

    call_at, call_n, calls = _lists(answers["calls"])
    stop_at, stop_n, stops = _lists(answers["stops"])
    codes = calls.field("code").dictionary_encode() if len(calls) else None
    names = codes.dictionary if codes is not None else pa.array([], pa.string())
    order = np.asarray(pc.sort_indices(names))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    sorted_names = names.take(pa.array(order))
    code = rank[np.asarray(codes.indices)] if codes is not None else np.zeros(0, np.int64)
    shut, stops = np.asarray(calls.field("shut")) if len(calls) else np.zeros(0, np.int64), np.asarray(stops)
    numbers = np.unique(np.r_[shut, stops])  # one number for each exclude
    shut, stops = np.searchsorted(numbers, shut), np.searchsorted(numbers, stops)
    asked = answers["word"].combine_chunks()
    out = []
    for at in range(0, part.num_rows, _TEXTS):
        rows = part.slice(at, _TEXTS)
        _, n, words = _lists(rows.column("_plain"))
        place = np.asarray(pc.index_in(words, value_set=asked).fill_null(-1)).astype(np.int64)
        row = np.repeat(np.arange(rows.num_rows), n)[place >= 0]
        place = place[place >= 0]
        by, item = _drawn(place, call_at, call_n)
        stopped_by, stop = _drawn(place, stop_at, stop_n)
        size = max(1, len(numbers))
        free = ~np.isin(row[by] * size + shut[item], row[stopped_by] * size + stops[stop])
        width = max(1, len(names))
        pairs = np.unique(row[by][free] * width + code[item[free]])
        ends = np.r_[0, np.cumsum(np.bincount(pairs // width, minlength=rows.num_rows))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), sorted_names.take(pa.array(pairs % width)))
        out.append(rows.drop_columns([PART, "_plain"]).append_column("_settled", lists))
    return pa.concat_tables(out) if out else part.drop_columns([PART, "_plain"]).append_column("_settled", pa.array([], pa.list_(pa.string())))


def _with_settled(df: DataFrame, index: RuleIndex, corpus: str) -> DataFrame:
    """``df`` with ``_settled``: the codes of the plain rules that hold. Rows travel once, dealt by all they hold."""
    keys = [f.name for f in df.schema if f.name == corpus or isinstance(f.dataType, T.AtomicType)]
    dealt = df.withColumns({"_plain": plain_words(F.col(corpus)), "_row_key": F.xxhash64(*[F.col(f"`{c}`") for c in keys])})
    rows = in_parts(dealt, "_row_key").select(PART, *[F.col(f"`{c}`") for c in df.columns], "_plain")
    asked = rows.groupBy(PART).applyInArrow(_asked, f"{PART} int, word string")
    answers = answers_to_parts(asked.join(index.plain, "word").select(PART, "word", "calls", "stops"))
    kinds = T.StructType([*df.schema.fields, T.StructField("_settled", T.ArrayType(T.StringType()))])
    return rows.groupBy(PART).cogroup(answers.groupBy(PART)).applyInArrow(_settled, kinds)


def _as_tried(rows: DataFrame) -> DataFrame:
    made = F.struct("code", F.concat(F.lit(FLAGS), "include").alias("include"), F.concat(F.lit(FLAGS), "exclude").alias("exclude"))
    return rows.withColumn("_tried", made)


def indexed_sets(df: DataFrame, index: RuleIndex, corpus: str = "corpus", out: str = "codes") -> DataFrame:
    """Every row of ``df`` with the sorted codes of the rules that hold, empty when none does.

    Texts meet their candidates by a hash of the text, so rows need no id, repeated texts are looked up once, and two texts of one
    hash only share their candidates. The words of the index go in broadcasts of at most ``BLOCK_WORDS``.
    """
    names = [c for c in df.columns if c != out]
    none = F.expr("cast(array() as array<string>)")
    rows = df.select(*names).withColumn("_settled", none) if index.plain.isEmpty() else _with_settled(df.select(*names), index, corpus)
    always = _as_tried(index.anywhere).agg(F.collect_list("_tried").alias("a")).scalar()
    rows, tried = rows.withColumn("_always", always), F.col("_always")
    if index.n_words:
        key = F.xxhash64(corpus)
        hits = df.select(key.alias("_text_key"), F.explode(letter_words(F.col(corpus))).alias("word"))
        blocks = max(1, -(-index.n_words // BLOCK_WORDS))
        for i in range(blocks):
            own = index.words if blocks == 1 else index.words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i)
            hits = hits.join(F.broadcast(own.withColumnRenamed("rules", f"_r{i}")), "word", "left" if blocks > 1 else "inner")
        called = hits.select("_text_key", F.explode(F.coalesce(*[f"_r{i}" for i in range(blocks)])).alias("rule")).distinct()
        near = _as_tried(called.join(index.rules, "rule")).groupBy("_text_key").agg(F.collect_list("_tried").alias("_near"))
        rows = rows.withColumn("_text_key", key).join(near, "_text_key", "left")
        tried = F.when(F.col("_near").isNull(), tried).otherwise(F.concat("_near", tried))
    text = F.col(corpus)

    def holds(rule: Column) -> Column:
        shut = F.coalesce(F.rlike(text, rule["exclude"]), F.lit(False))
        return F.rlike(text, rule["include"]) & ~shut

    codes = code_set(F.concat(F.coalesce("_settled", none), F.transform(F.filter(tried, holds), lambda r: r["code"])))
    return rows.withColumn(out, codes).select(*names, out)

"""Column expressions for names, addresses, corpora, tokens and n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark import fixed

_EMPTY = "cast(array() as array<string>)"


def stopwords(extra: Sequence[str] = tuple(fixed.ADDED_STOPWORDS)) -> list[str]:
    """English stop words plus ``extra``, without repeats, in order."""
    return list(dict.fromkeys([*fixed.ENGLISH_STOPWORDS, *extra]))


def blank_to_null(col: Column) -> Column:
    """Null where the text is missing or only blanks, as after a CSV round trip."""
    return F.when(F.trim(col) != "", col)


def clean_words(col: Column, stop: Sequence[str] | None = None) -> Column:
    """Lower-case words of ``col`` without symbols and stop words, in order."""
    spaced = F.regexp_replace(F.lower(col), fixed.SPACE_CHARS, " ")
    bare = F.regexp_replace(spaced, fixed.DROPPED_CHARS, "")
    # isin() becomes a hash lookup; array_contains() would scan the list per word.
    stop = stopwords() if stop is None else list(stop)
    return F.filter(F.split(bare, " +"), lambda w: (w != "") & ~w.isin(stop))


def clean_text(col: Column, stop: Sequence[str] | None = None) -> Column:
    """Cleaned text: the words of :func:`clean_words` joined by one space."""
    return F.array_join(clean_words(col, stop), " ")


def corpus_column(
    df: DataFrame,
    fields: Sequence[str] = fixed.DEFAULT_FIELDS,
    fill_from: tuple[str, str] | None = ("activities", "objects"),
    clean: bool = False,
) -> Column:
    """Text of one record: fields joined by a space, nulls as empty text.

    ``fill_from=(a, b)`` takes ``b`` where ``a`` is null or blank, if both are in play.
    """
    parts = []
    for name in fields:
        col = F.col(name)
        if fill_from and name == fill_from[0] and fill_from[1] in df.columns:
            col = F.coalesce(blank_to_null(col), F.col(fill_from[1]))
        # concat_ws drops nulls together with their blank, so fill first.
        parts.append(F.coalesce(col, F.lit("")))
    joined = F.concat_ws(" ", *parts)
    return clean_text(joined) if clean else joined


def text_corpus(
    df: DataFrame,
    fields: Sequence[str] = fixed.DEFAULT_FIELDS,
    fill_from: tuple[str, str] | None = ("activities", "objects"),
    clean: bool = False,
    out: str = "corpus",
) -> DataFrame:
    return df.withColumn(out, corpus_column(df, fields, fill_from, clean))


def corpus_length(
    df: DataFrame,
    fields: Sequence[str] = fixed.DEFAULT_FIELDS,
    fill_from: tuple[str, str] | None = ("activities", "objects"),
    out: str = "corpus_length",
) -> DataFrame:
    return df.withColumn(out, F.length(corpus_column(df, fields, fill_from)))


def flatten_newlines(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null becomes empty text and a newline becomes a space."""
    flat = {c: F.translate(F.coalesce(F.col(c), F.lit("")), "\n", " ") for c in cols}
    return df.withColumns(flat)


def postcode_from_address(col: Column) -> Column:
    """Last part of an address written ``a, b, c``; empty text for null."""
    return F.substring_index(F.coalesce(col, F.lit("")), ", ", -1)


def regnumber_to_orgid(col: Column) -> Column:
    """Organisation id from a register number by its first letter."""
    digits = F.regexp_replace(col, "[^0-9]", "")
    # lpad would cut a longer number, so pad only the short ones.
    six = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return (
        F.when(F.startswith(col, F.lit("N")), F.concat(F.lit("GB-NIC-"), digits))
        .when(F.startswith(col, F.lit("S")), F.concat(F.lit("GB-SC-SC"), six))
        .otherwise(F.concat(F.lit("GB-CHC-"), col))
    )


def word_tokens(col: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(fixed.WORD_RUN), F.lit(0))


def word_ngrams(tokens: Column, n_max: int, n_min: int = 1) -> Column:
    """All n-grams for ``n_min..n_max``, the parts joined by one space."""
    if n_min < 1 or n_max < n_min:
        raise ValueError("n-gram sizes must satisfy 1 <= n_min <= n_max")

    def grams(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        made = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, made).otherwise(F.expr(_EMPTY))

    sizes = [grams(n) for n in range(n_min, n_max + 1)]
    return sizes[0] if len(sizes) == 1 else F.concat(*sizes)


def char_wb_ngrams(col: Column, n_max: int, n_min: int = 3) -> Column:
    """Character n-grams inside words padded by a blank on both sides.

    A padded word shorter than ``n_min`` gives itself once.
    """
    if n_min < 1 or n_max < n_min:
        raise ValueError("n-gram sizes must satisfy 1 <= n_min <= n_max")
    words = F.filter(F.split(F.lower(col), fixed.WHITESPACE), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(word: Column, n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(word, i, n))

    def of_word(word: Column) -> Column:
        top = F.greatest(F.least(F.length(word), F.lit(n_max)), F.lit(n_min))
        return F.flatten(F.transform(F.sequence(F.lit(n_min), top), lambda n: of_size(word, n)))

    return F.flatten(F.transform(padded, of_word))

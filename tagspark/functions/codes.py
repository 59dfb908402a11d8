"""Column expressions for codes, code sets, bands and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "cast(array() as array<string>)"


def no_codes() -> Column:
    return F.expr(_EMPTY)


def code_set(codes: Column) -> Column:
    """Sorted unique codes; null counts as the empty set."""
    return F.coalesce(F.array_sort(F.array_distinct(codes)), no_codes())


def split_codes(col: Column, sep: str = ";") -> Column:
    """``"A; B;"`` to ``[A, B]``; null to the empty list."""
    parts = F.transform(F.split(col, rf"\Q{sep}\E"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), no_codes())


def join_codes(col: Column, sep: str = ";") -> Column:
    """A set of codes as one sorted text."""
    return F.array_join(code_set(col), sep)


def union_codes(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def group_codes(code: Column) -> Column:
    """A code with its parents: two letters, and ``xx?00`` when its third
    character is a digit above 1."""
    third = F.substring(code, 3, 1)
    middle = F.when(third.rlike("^[2-9]$"), F.concat(F.substring(code, 1, 3), F.lit("00")))
    return F.array_compact(F.array(code, F.substring(code, 1, 2), middle))


def with_groups(codes: Column) -> Column:
    """A code set widened by the parents of every code."""
    return code_set(F.flatten(F.transform(codes, group_codes)))


def code_prefixes(code: Column) -> Column:
    """Every prefix of a code, the code itself last."""
    return F.when(
        F.length(code) > 0,
        F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.substring(code, F.lit(1), i)),
    )


def section_of(col: Column) -> Column:
    return F.substring(col, 1, 1)


def band(col: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bands ``(lo, hi]``; null outside, for null and for NaN."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    out = F.when(col.isNull() | F.isnan(col.cast("double")) | (col <= edges[0]), None)
    for hi, label in zip(edges[1:], labels, strict=True):
        out = out.when(col <= hi, label)
    return out


def income_band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    return band(col, edges, labels)


def round_score(col: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(col, digits)


def order_key(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def explode_rows(df: DataFrame, keep: Sequence[str], items: str | Column, out: str) -> DataFrame:
    """One row per item that is not null.

    A plain ``explode`` of a column makes the optimiser add a "not empty" filter
    below it, which would work out the column (all patterns, all tokens) twice;
    the outer form does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(out)).where(F.col(out).isNotNull())

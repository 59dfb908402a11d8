"""Order MinHash in DataFrame functions alone.

A text's k-mers are runs of ``K`` words. Each is numbered among its equals, so repeats count. One hash of
k-mer and number both picks one of 64 bins and ranks it there; the ``L`` smallest of a bin are put
back into text order and hashed together. The tuples of all bins are the fingerprint: two texts agree in a bin
if the same k-mers stand there in the same order, so moved text costs likeness as edits do.

All of it happens inside the row, on sorted arrays of longs (hash above, place in the text below).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark.llm.common import table

K, L = 3, 2
#: Lower bits that hold a place in the text, upper bits that hold the bin.
PLACE, BIN = 24, 6
#: Rows for each range of ids, and the most ranges; they bound what the driver sees.
RANGE_ROWS, RANGES = 500, 1 << 14


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: one long for each bin that has a k-mer, the bin above and 32 bits of the tuple's hash below.

    Null and empty texts have none; texts of fewer than ``K`` words have one k-mer, all their words. Whole
    texts are used. Each step is a projection of its own, so no array is worked out twice.
    """
    mask = (1 << PLACE) - 1
    h, s, k, w, c = (f"{out}__{x}" for x in "hskwc")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D\x20]+"), lambda x: x != "")
    df = df.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))
    grams = F.transform(h, lambda x, i: F.xxhash64(x, *(_at(F.col(h), i + j) for j in range(1, K))))
    length = F.greatest(F.size(h) - (K - 1), F.least(F.size(h), F.lit(1)))
    df = df.withColumn(k, F.slice(grams, F.lit(1), length)).drop(h)
    # equal k-mers stand side by side, in text order
    df = df.withColumn(s, F.array_sort(F.transform(k, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))))

    def same(x: Column, j: Column) -> Column:
        return F.coalesce(F.shiftright(_at(F.col(s), j), PLACE) == F.shiftright(x, PLACE), F.lit(False))

    steps = F.array(*(F.lit(1 << b) for b in reversed(range(PLACE))))

    def number(x: Column, j: Column) -> Column:
        """How many equals stand before: found by doubling steps, and only where there is one."""
        reach = F.aggregate(steps, F.lit(0), lambda done, step: F.when(same(x, j - done - step), done + step).otherwise(done))
        return F.when(same(x, j - 1), reach).otherwise(F.lit(0))

    ranked = F.transform(s, lambda x, j: F.xxhash64(F.shiftright(x, PLACE), number(x, j)).bitwiseAND(F.lit(~mask)).bitwiseOR(x.bitwiseAND(F.lit(mask))))
    df = df.withColumn(w, F.array_sort(ranked)).drop(s)

    def bin_(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - BIN)

    # the smallest of each bin, at most L; an earlier one of the same bin L places before means enough are taken
    df = df.withColumn(c, F.filter(w, lambda x, j: ~F.coalesce(bin_(_at(F.col(w), j - L)) == bin_(x), F.lit(False)))).drop(w)

    def tuple_(x: Column, j: Column) -> Column:
        first = ~F.coalesce(bin_(_at(F.col(c), j - 1)) == bin_(x), F.lit(False))
        near = [F.when(bin_(_at(F.col(c), j + i)) == bin_(x), _at(F.col(c), j + i).bitwiseAND(F.lit(mask))) for i in range(1, L)]
        places = F.array_sort(F.filter(F.array(x.bitwiseAND(F.lit(mask)), *near), lambda p: p.isNotNull()))
        kmers = F.transform(places, lambda p: _at(F.col(k), p))
        return F.when(first, F.shiftleft(bin_(x), 32).bitwiseOR(F.xxhash64(kmers).bitwiseAND(F.lit(0xFFFFFFFF))))

    return df.withColumn(out, F.filter(F.transform(c, tuple_), lambda x: x.isNotNull())).drop(k, c)


def printed(signature: str) -> Column:
    """Ten hexadecimal digits for each bin: two for its number, eight for the tuple."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal bins among those that either text fills; 1 for two texts without any."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    filled = F.size(F.array_union(bins(F.col(a)), bins(F.col(b))))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def with_next(df: DataFrame, columns: list[str], tie: Column) -> DataFrame:
    """Each row with the struct ``next`` of ``columns`` of the row that follows in doc_id order (the last: of the first).

    Ids are cut into ranges by approximate percentiles; each range is sorted on its own and gets a copy of
    the next range's first row. Rows of one id are ordered by ``tie``; null ids come first.
    """
    n, low = df.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    side = max(1, math.isqrt(ranges))
    cuts: list = []
    if low is not None and ranges > 1:
        cuts = sorted(set(df.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0]))
    # two steps of about the root of the number of ranges find a row's range
    fine = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>") if xs else F.array().cast("array<long>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("doc_id")))
    coarse = F.coalesce(F.greatest(below(longs([x[0] for x in fine])) - 1, F.lit(0)), F.lit(0))
    deep = F.coalesce(below(F.get(F.array(*map(longs, fine)), coarse)), F.lit(0)) if fine else F.lit(0)
    placed = df.withColumn("range__", (coarse * side + deep).cast("int"))
    firsts = sorted(placed.groupBy("range__").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).collect())
    heads = [(r.range__, None if r.none else r.id, firsts[i - 1].range__) for i, r in enumerate(firsts)]
    head = F.broadcast(df.sparkSession.createDataFrame(heads, "r int, id long, before int"))
    copied = placed.join(head, (F.col("range__") == head.r) & head.id.eqNullSafe(F.col("doc_id")), "left")
    copies = F.array_compact(F.array(F.struct(F.col("range__").alias("at"), F.lit(False).alias("copy")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("at"), F.lit(True).alias("copy")))))
    spread = copied.withColumn("tie__", tie).withColumn("go__", F.explode(copies)).withColumns({"at__": F.col("go__.at"), "copy__": F.col("go__.copy")})
    w = Window.partitionBy("at__").orderBy("copy__", F.col("doc_id").asc_nulls_first(), "tie__")
    out = spread.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("not copy__")
    return out.select(*df.columns, "next")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its signature, the edited text and its signature, the next row's signature.

    The edited text keeps the first half of the code points (the middle one too) and goes on with as many as
    it lost of the next text, or all of it. Null counts as empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = signatures(rows, "text", "sig")
    chained = with_next(rows, ["text", "sig"], F.xxhash64("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    chained = chained.select(
        "doc_id", "sig", n.cast("long").alias("n_chars"), F.col("next.sig").alias("next_sig"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)).alias("edited"),
    )
    return signatures(chained, "edited", "edited_sig")


def op4_order_minhash(spark, sf: str) -> DataFrame:
    out = edited_neighbours(table(spark, sf, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed("sig").alias("fingerprint"), printed("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )

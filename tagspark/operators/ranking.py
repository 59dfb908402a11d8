"""First rows, top rows, samples and splits, all reproducible and exact at any size.

:func:`first_rows` takes the first rows of each group in two steps: of every ``PARTS`` parts of a group
first, then of what they leave, so a group that holds a third of all rows is never sorted in one place.
:func:`mark_first` finds one cut value per group by counting and compares every row with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.codes import order_key
from tagspark.operators.joins import hot_key_join
from tagspark.session import keep_table

#: Parts that a group is dealt into before its first rows are known.
PARTS = 64
#: Groups whose cut values may be broadcast; more are joined.
FEW_STRATA = 10_000
_HASH_HEX = 4


def _row_number(keys: Sequence[str], order: Sequence) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows of every group, for any ``n``; of equal rows any."""
    parts = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    near = parts.withColumn("_rn", _row_number([*keys, "_part"], order)).where(F.col("_rn") <= n)
    return near.withColumn("_rn", _row_number(keys, order)).where(F.col("_rn") <= n).drop("_rn", "_part")


def dedupe_first(
    df: DataFrame, keys: Sequence[str], order: Sequence = ("file_ord", "row_ord")
) -> DataFrame:
    return first_rows(df, keys, order, 1)


def distinct_pairs(
    tags: DataFrame, keys: Sequence[str] = ("org_id", "code"), order: Sequence = ("method",)
) -> DataFrame:
    """One row per record and code, the first by ``order``."""
    return first_rows(tags, keys, order, 1)


def distinct_sorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # The hash shuffle of distinct() keeps its files, so the sampling pass of
    # the sort does not run the upstream patterns a second time.
    return df.distinct().orderBy(*keys)


def sort_output(df: DataFrame, cols: Sequence) -> DataFrame:
    return df.orderBy(*cols)


def place_within(df: DataFrame, by: str, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: each row's place, from 1, among the rows of its group; of equal rows any comes first.

    Rows are dealt by ranges of group and order and kept, so a large group lies over many tasks; a row for each task and group says how many
    rows of the group stand before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order)
    rows = keep_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", 33)
    counted = rows.groupBy(part.alias("_task"), F.col(by).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    met = rows.join(before, (part == F.col("_task")) & F.col(by).eqNullSafe(F.col("_group")))
    return met.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(out))


def top_n_by_income(df: DataFrame, n: int, col: str = "income", id: str = "org_id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(col), id).limit(n)


def top_n_per_code(
    df: DataFrame, n: int = 10, code: str = "code", col: str = "income", id: str = "org_id"
) -> DataFrame:
    return first_rows(df, [code], [F.desc_nulls_last(col), F.col(id)], n)


def sample_n_per_code(
    df: DataFrame,
    n: int = 10,
    seed: int = 42,
    min_size: int = 10,
    code: str = "code",
    id: str = "org_id",
) -> DataFrame:
    """``n`` random records of every code that has more than ``min_size``."""
    big = df.groupBy(code).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_size)
    picked = first_rows(df, [code], [order_key(F.col(id), seed)], n)
    return picked.join(big.select(code), code, "left_semi")


def sample_n_per_stratum(
    df: DataFrame, strata: Sequence[str], n: int, seed: int, id: str = "org_id"
) -> DataFrame:
    """``n`` random records per combination; rows without a stratum are left out."""
    rows = df.dropna(subset=list(strata))
    return mark_first(rows, id, seed, strata, rows=n).where("picked").drop("picked")


def sample_n(df: DataFrame, n: int, seed: int, id: str = "org_id") -> DataFrame:
    """``n`` random records."""
    return mark_first(df, id, seed, rows=n).where("picked").drop("picked")


def mark_first(
    df: DataFrame,
    id: str,
    seed: int,
    strata: Sequence[str] = (),
    rows: int | Mapping[str, int] | None = None,
    share: float | None = None,
    out: str = "picked",
) -> DataFrame:
    """Mark exactly the first ``rows`` (or ``ceil(share * size)``) records of
    every stratum in hash order, without sorting or moving the table.

    Hash prefixes are counted, the prefix that holds the cut is found per stratum, only its few rows are
    ranked, and the cut is compared to every row in place. ``rows`` may give one number per value of a
    single stratum column. Repeated ids are ordered by their rows' contents, and so are rows without an
    id; of fully equal rows at the cut as many are marked as are wanted.
    """
    if (rows is None) == (share is None):
        raise ValueError("give either rows or share")
    strata = list(strata)
    content = F.lower(F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0"))
    key = F.concat(F.coalesce(order_key(F.col(id), seed), order_key(F.concat(F.lit("\x00"), content), seed)), content)
    hashed = df.select(*strata, key.alias("_h")).withColumn("_b", F.substring("_h", 1, _HASH_HEX))
    sizes = hashed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*strata)
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(group)
    if share is not None:
        want = F.ceil(F.round(total * F.lit(float(share)), 9))
    elif isinstance(rows, Mapping):
        want = F.lit(0)
        for value, n in rows.items():
            want = F.when(F.col(strata[0]) == value, F.lit(n)).otherwise(want)
    else:
        want = F.lit(rows)
    cut_prefix = (
        sizes.withColumn("_want", F.least(want.cast("long"), total))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want")))
        .select(*[F.col(s).alias(f"_s_{s}") for s in strata], F.col("_b").alias("_cut_b"),
                (F.col("_want") - F.col("_before")).alias("_rank"))
    )
    same = F.col("_b") == F.col("_cut_b")
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_s_{s}"))
    border = hashed.join(cut_prefix, same)
    w = Window.partitionBy(*strata, "_b").orderBy("_h")
    ranked = border.withColumns({"_rn": F.row_number().over(w), "_first": F.rank().over(w)})
    # the cut, and how many of the rows equal to it are in
    cuts = ranked.where(F.col("_rn") == F.col("_rank")).select(*strata, F.col("_h").alias("_cut"), (F.col("_rn") - F.col("_first") + 1).alias("_equal"))
    joined = _with_cuts(df, cuts, sizes, strata, key)
    marked = joined.withColumn("_key", key)
    below = marked.where((F.col("_key") < F.col("_cut")) | (F.col("_key") > F.col("_cut")) | F.col("_cut").isNull()).select(
        *df.columns, F.coalesce(F.col("_key") < F.col("_cut"), F.lit(False)).alias(out)
    )
    at = marked.where(F.col("_key") == F.col("_cut"))
    at = at.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata, "_key").orderBy("_key")))
    return below.union(at.select(*df.columns, (F.col("_rn") <= F.col("_equal")).alias(out)))


def _with_cuts(df: DataFrame, cuts: DataFrame, sizes: DataFrame, strata: Sequence[str], key: Column) -> DataFrame:
    """Every row with the cut of its stratum, if it has one, without moving rows by stratum.

    Cut values of few strata (counted) are broadcast; those of many go through ``hot_key_join``.
    """
    if not strata:
        # the one cut joins on an empty text that stands for the whole table
        rows = df.withColumn("_stratum", F.substring(key, 1, 0))
        one = cuts.select(F.substring("_cut", 1, 0).alias("_stratum"), "_cut", "_equal")
        return rows.join(F.broadcast(one), "_stratum", "left")
    name = F.to_json(F.struct(*strata), {"ignoreNullFields": "false"})
    per = sizes.groupBy(*strata).agg(F.sum("_n").alias("_rows")).withColumn("_stratum", name)
    known = per.join(cuts.select(name.alias("_stratum"), "_cut", "_equal"), "_stratum", "left")
    rows = df.withColumn("_stratum", name)
    if per.count() <= FEW_STRATA:
        return rows.join(F.broadcast(known.select("_stratum", "_cut", "_equal")), "_stratum", "left")
    content = rows.withColumn("_spread", F.xxhash64(*df.columns))
    return hot_key_join(content, known.select("_stratum", "_rows", "_cut", "_equal"), "_stratum", "_rows", ["_cut", "_equal"], "_spread")


def split_holdout(
    df: DataFrame, key: str = "org_id", test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Shuffled split of exact size: (development, test), disjoint and complete."""
    _check_share(test_size)
    marked = mark_first(df, key, seed, share=test_size)
    return marked.where(~F.col("picked")).drop("picked"), marked.where("picked").drop("picked")


def split_stratified(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The same within every class."""
    _check_share(test_size)
    marked = mark_first(df, key, seed, [label], share=test_size)
    return marked.where(~F.col("picked")).drop("picked"), marked.where("picked").drop("picked")


def _check_share(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")


def argmax_class(
    scores: DataFrame,
    id: str = "org_id",
    code: str = "code",
    score: str = "score",
    out: str = "class_code",
    digits: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Best class and its score; the first code wins a tie."""
    order = F.struct((-F.col(score)).alias("neg"), F.col(code).alias("code"))
    best = scores.groupBy(*by, id).agg(F.min(order).alias("_best"))
    value = -F.col("_best.neg")
    value = F.bround(value, digits) if digits is not None else value
    return best.select(
        *by, id, F.col("_best.code").alias(out), value.alias(f"{out}_probability")
    )


def top3_classes(
    scores: DataFrame, id: str = "org_id", code: str = "code", score: str = "score"
) -> DataFrame:
    """Three best classes with their scores in one row."""
    order = F.struct((-F.col(score)).alias("neg"), F.col(code).alias("code"))
    lists = scores.groupBy(id).agg(F.array_sort(F.collect_list(order)).alias("_s"))
    cols = []
    for i in (1, 2, 3):
        item = F.try_element_at("_s", F.lit(i))
        cols += [item["code"].alias(f"code_{i}"), (-item["neg"]).alias(f"prob_{i}")]
    return lists.select(id, *cols)


def rank_settings(
    summary: DataFrame,
    metric: str,
    ascending: bool | None = None,
    by: Sequence[str] = ("grid_approach",),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Settings of each approach ranked by a metric (Hamming loss: lowest first)."""
    if ascending is None:
        ascending = metric.startswith("hamming_loss")
    first = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return summary.withColumn("rank", _row_number(by, [first, *tie]))


def show_top(
    summary: DataFrame, n: int, dedupe_cols: Sequence[str] = tuple(fixed.SHOW_TOP_KEYS), order: Sequence = ("rank",)
) -> DataFrame:
    """First ``n`` settings, after keeping the first of those that are shown alike."""
    rows = first_rows(summary, dedupe_cols, order, 1) if dedupe_cols else summary
    return rows.orderBy(*order).limit(n)


def bulk_exclude(
    df: DataFrame, patterns: Mapping[str, str], col: str = "name"
) -> tuple[DataFrame, DataFrame]:
    """Take easy groups out by name: (remaining rows, count per group).

    A record counts for the first group it matches.
    """
    group = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        hit = F.coalesce(F.col(col).rlike(f"(?iU){pattern}"), F.lit(False))
        group = F.when(hit, F.lit(name)).otherwise(group)
    marked = df.withColumn("excluded_group", group)
    rest = marked.where(F.col("excluded_group").isNull()).drop("excluded_group")
    counts = (
        marked.where(F.col("excluded_group").isNotNull())
        .groupBy("excluded_group")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rest, counts


def two_band_sample(
    df: DataFrame, col: str, cut: float, n_low: int, n_high: int, seed: int, id: str = "org_id"
) -> DataFrame:
    """Random records from below and from at or above ``cut``, sized apart."""
    banded = df.where(F.col(col).isNotNull()).withColumn(
        "sample_band", F.when(F.col(col) >= cut, "high").otherwise("low")
    )
    marked = mark_first(banded, id, seed, ["sample_band"], rows={"low": n_low, "high": n_high})
    return marked.where("picked").drop("picked")

"""Counts, shares, cross-tabulations and reports.

Wide groupings come first and are combined per task; totals, shares and zero
rows are then worked out on the small result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.codes import code_prefixes
from tagspark.functions.text import clean_words, word_ngrams



def _total(counts: DataFrame, col: str = "n") -> Column:
    """Sum of a column of counts, as a scalar subquery."""
    return counts.agg(F.sum(col).alias("total")).scalar()


def collect_codes(tags: DataFrame, id: str = "org_id", out: str = "codes") -> DataFrame:
    return tags.groupBy(id).agg(F.array_sort(F.collect_set("code")).alias(out))


def group_size(df: DataFrame, cols: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per combination; rows without one are left out."""
    return df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def value_share(df: DataFrame, col: str, normalise: bool = False) -> DataFrame:
    """Rows per value that is not null, as counts or as shares."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if not normalise:
        return counts
    return counts.select(col, (F.col("n") / _total(counts)).alias("share"))


def distribution(
    df: DataFrame, field: str, member_ids: DataFrame, id: str = "org_id", total: str = "Total"
) -> DataFrame:
    """Per value: rows in all, rows that are members, and their share; a total row."""
    members = member_ids.select(id).distinct().withColumn("_in", F.lit(1))
    counts = (
        df.select(id, field)
        .where(F.col(field).isNotNull())
        .join(members, id, "left")
        .groupBy(field)
        .agg(F.count(F.lit(1)).alias("all_n"), F.count("_in").alias("category_n"))
    )
    rolled = counts.rollup(field).agg(
        F.sum("all_n").alias("all_n"),
        F.sum("category_n").alias("category_n"),
        F.grouping(field).alias("_g"),
    )
    return rolled.select(
        F.when(F.col("_g") == 1, total).otherwise(F.col(field)).alias(field),
        "all_n",
        "category_n",
        (F.col("category_n") / F.nullif(F.col("all_n"), F.lit(0))).alias("percentage"),
    )


def prefix_match(
    tags: DataFrame, codes: DataFrame, id: str = "org_id", code: str = "code"
) -> DataFrame:
    """Records that have a code starting with each given code.

    Every code is cut into its few prefixes, so this is an equi-join.
    """
    wanted = codes.select(F.col("code").alias("prefix")).distinct()
    cut = tags.select(id, F.explode(code_prefixes(F.col(code))).alias("prefix"))
    return cut.join(wanted, "prefix").select(id, F.col("prefix").alias("code")).distinct()


def category_report(
    records: DataFrame,
    tags: DataFrame,
    taxonomy: DataFrame,
    fields: Sequence[str],
    id: str = "org_id",
    total: str = "Total",
) -> DataFrame:
    """:func:`distribution` for every code of the taxonomy and several fields at once.

    Long form: code, field, value, all_n, category_n, percentage. One grouped
    pass over the tags and one over the records, whatever the number of codes.
    """
    def unpivot(df: DataFrame, *keys: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
        )
        cells = df.select(*keys, F.explode(pairs).alias("_c"))
        return cells.select(*keys, "_c.field", "_c.value").where(F.col("value").isNotNull())

    rows = records.select(id, *fields)
    all_n = unpivot(rows).groupBy("field", "value").agg(F.count(F.lit(1)).alias("all_n"))
    members = prefix_match(tags, taxonomy, id).join(rows, id)
    in_code = (
        unpivot(members, "code")
        .groupBy("code", "field", "value")
        .agg(F.count(F.lit(1)).alias("category_n"))
    )
    # Every code gets every value, also with no record: the list of values is
    # one small row, spread by explode.
    values = all_n.agg(F.collect_list(F.struct("field", "value", "all_n")).alias("v"))
    frame = (
        taxonomy.select("code")
        .distinct()
        .select("code", F.explode(values.scalar()).alias("_v"))
        .select("code", "_v.*")
    )
    cells = frame.join(in_code, ["code", "field", "value"], "left").withColumn(
        "category_n", F.coalesce("category_n", F.lit(0))
    )
    rolled = cells.groupBy("code", "field").agg(
        F.sum("all_n").alias("all_n"), F.sum("category_n").alias("category_n")
    )
    both = cells.unionByName(rolled.withColumn("value", F.lit(total)))
    return both.select(
        "code",
        "field",
        "value",
        "all_n",
        "category_n",
        (F.col("category_n") / F.nullif(F.col("all_n"), F.lit(0))).alias("percentage"),
    )


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence) -> DataFrame:
    """Counts of ``a`` by the given values of ``b``, zeros included."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isin(list(b_values)))
    wide = rows.groupBy(a).agg(
        *[F.count_if(F.col(b) == v).alias(str(v)) for v in b_values]
    )
    return wide


def crosstab_share(
    df: DataFrame, a: str, b: str, b_values: Sequence, by: str = "row", digits: int = 1
) -> DataFrame:
    """The same as percentages of the row or of the column."""
    counts = (
        df.where(F.col(a).isNotNull() & F.col(b).isin(list(b_values)))
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    whole = F.sum("_n").over(Window.partitionBy(a if by == "row" else b))
    share = counts.withColumn("_p", F.col("_n") / whole * 100)
    return share.groupBy(a).agg(
        *[
            F.coalesce(F.round(F.max(F.when(F.col(b) == v, F.col("_p"))), digits), F.lit(0.0)).alias(str(v))
            for v in b_values
        ]
    )


def crosstab_margins(
    tags: DataFrame, taxonomy: DataFrame, n_records: int | Column, id: str = "org_id"
) -> DataFrame:
    """Records per top category that carry it directly or through a finer code.

    A record with both counts as direct. Sorted by total, largest first.
    """
    methods = tags.groupBy(id, F.substring("code", 1, 2).alias("code")).agg(
        F.max(F.length("code") == 2).alias("_direct")
    )
    counts = methods.groupBy("code").agg(
        F.count_if("_direct").alias("direct"),
        F.count_if(~F.col("_direct")).alias("indirect"),
        F.count(F.lit(1)).alias("total"),
    )
    n = F.lit(n_records) if isinstance(n_records, int) else n_records
    named = counts.join(taxonomy.select("code", "tag"), "code")
    shares = {f"{c}_percent": F.round(F.col(c) / n * 100, 1) for c in ("direct", "indirect", "total")}
    return named.withColumns(shares).drop("code").orderBy(F.desc("total"), "tag")


def cap_bucket(counts: DataFrame, cap: int = 15, col: str = "n_codes") -> DataFrame:
    """Histogram of a count, large ones in one bucket, with percentages."""
    bucket = F.when(F.col(col) >= cap, f"{cap} or over").otherwise(F.col(col).cast("string"))
    grouped = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("percent", F.round(F.col("n") / _total(grouped) * 100, 1))


def tags_per_record(
    records: DataFrame, tags: DataFrame, cap: int = 15, id: str = "org_id"
) -> DataFrame:
    """How many records have how many tags, untagged ones included.

    Records and tags are stacked and grouped once, so no join is needed.
    """
    rows = records.select(id, F.lit(1).alias("_r"), F.lit(0).alias("_t")).unionByName(
        tags.select(id, F.lit(0).alias("_r"), F.lit(1).alias("_t"))
    )
    counts = rows.groupBy(id).agg(F.max("_r").alias("_r"), F.sum("_t").alias("n_codes"))
    return cap_bucket(counts.where("_r = 1"), cap)


def describe_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation, quartiles and their range per group.

    The exact percentile keeps one counter per distinct value, combined per
    task, so its size follows the spread of lengths and not the rows.
    """
    quarters = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        quarters.alias("_q"),
    )
    q1, q2, q3 = (F.col("_q")[i] for i in range(3))
    return stats.select(
        by, "count", "mean", "std", "min", q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
        "max", (q3 - q1).alias("iqr"),
    )


def hist(
    df: DataFrame, value: str, by: str, lo: float = 0.0, hi: float = 1.0, bins: int = 20
) -> DataFrame:
    """Rows per equal-width bin and group; the last bin holds its upper edge."""
    x = F.col(value)
    number = F.least(F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins))
    rows = df.where((x >= lo) & (x <= hi)).select(by, number.alias("bin"))
    return rows.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))


def bin2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Rows per square of two values."""
    cells = df.select(
        F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin")
    )
    return cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def actual_vs_predicted(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """How often each code occurs and is predicted, in one pass."""
    pairs = F.array(
        F.struct(F.col(truth).alias("code"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col(pred).alias("code"), F.lit(0).alias("a"), F.lit(1).alias("p")),
    )
    rows = df.select(F.explode(pairs).alias("_x")).select("_x.*").where(F.col("code").isNotNull())
    return rows.groupBy("code").agg(F.sum("a").alias("actual"), F.sum("p").alias("predicted"))


def taxonomy_code(
    df: DataFrame, cols: Sequence[str] = ("sub_group", "group", "section"), out: str = "code"
) -> DataFrame:
    """The finest code given: sub-group, else group, else section."""
    return df.withColumn(out, F.coalesce(*cols))


def taxonomy_prune(df: DataFrame, unused_col: str, keep: Sequence[str]) -> DataFrame:
    """Only codes in use, only the wanted columns."""
    return df.where(F.col(unused_col).isNull()).select(*keep)


def taxonomy_levels(taxonomy: DataFrame, level: str = "level") -> DataFrame:
    x = F.col(level)
    return taxonomy.agg(
        F.count_if(x == 1).alias("n_categories"),
        F.count_if(x == 2).alias("n_subcategories"),
        F.count_if(x >= 2).alias("n_tags"),
    )


def label_support(df: DataFrame, label: str) -> DataFrame:
    """Number of classes, and size of the smallest one."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_labels"), F.min("_n").alias("smallest"))


def can_stratify(df: DataFrame, label: str) -> bool:
    """Action: whether every class has two rows or more, and there is more than one."""
    row = label_support(df, label).first()
    return row["n_labels"] > 1 and row["smallest"] >= 2


def label_terms(
    gold: DataFrame,
    n: int = 20,
    text: str = "corpus",
    codes: str = "true_codes",
    n_max: int = 2,
) -> DataFrame:
    """Most frequent words and word pairs among the records of each tag."""
    from tagspark.operators.ranking import first_rows

    grams = word_ngrams(F.col("_w"), n_max)
    rows = (
        gold.select(codes, clean_words(F.col(text)).alias("_w"))
        .select(codes, F.explode(grams).alias("term"))
        .groupBy(codes, "term")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.explode(codes).alias("code"), "term", "_n")
        .groupBy("code", "term")
        .agg(F.sum("_n").alias("n"))
    )
    return first_rows(rows, ["code"], [F.desc("n"), F.col("term")], n)


def rule_misses(eval_rows: DataFrame, id: str = "org_id") -> DataFrame:
    """Codes each record lacks or has in excess, row by row and without a join."""
    def side(codes: Column, kind: str) -> Column:
        return F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit(kind).alias("kind")))

    missed = F.array_except("true_codes", "predicted_codes")
    extra = F.array_except("predicted_codes", "true_codes")
    both = F.concat(side(missed, "false_negative"), side(extra, "false_positive"))
    return eval_rows.select(id, F.explode(both).alias("_m")).select(id, "_m.*")


def coder_agreement(
    codings: DataFrame, item: str = "item", label: str = "label"
) -> DataFrame:
    """Share of items by the largest number of coders who gave the same label.

    ``one`` means that no two agree, ``all`` that everybody does.
    """
    votes = codings.groupBy(item, label).agg(F.count(F.lit(1)).alias("_v"))
    items = votes.groupBy(item).agg(F.max("_v").alias("agreeing"), F.sum("_v").alias("coders"))
    counts = items.groupBy("coders", "agreeing").agg(F.count(F.lit(1)).alias("items"))
    share = F.col("items") / F.sum("items").over(Window.partitionBy("coders"))
    verdict = (
        F.when(F.col("agreeing") == F.col("coders"), "all")
        .when(F.col("agreeing") == 1, "none")
        .otherwise("some")
    )
    return counts.select("coders", "agreeing", verdict.alias("agreement"), "items", share.alias("share"))


def accuracy_by_group(
    df: DataFrame,
    groups: Sequence[tuple[str, int, int]],
    count: str = "source_count",
    flags: Sequence[str] = ("correct",),
) -> DataFrame:
    """Accuracy per group of candidate counts; groups may overlap.

    The few groups are literals, so a row picks its own groups in place and no
    range join is needed.
    """
    c = F.col(count)
    names = F.array_compact(
        F.array(*[F.when(c.between(lo, hi), F.lit(name)) for name, lo, hi in groups])
    )
    rows = df.select(F.explode(names).alias("group"), *flags)
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags]
    )


def exact_match_flags(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Whether the code is right, and whether its section is."""
    same = F.substring(truth, 1, 1) == F.substring(pred, 1, 1)
    return df.withColumn("correct", F.col(truth) == F.col(pred)).withColumn("sector_correct", same)


def grid_mean_std(
    per_state: DataFrame,
    keys: Sequence[str] = tuple(fixed.GRID_KEYS),
    metrics: Sequence[str] = tuple(fixed.METRICS),
) -> DataFrame:
    """Mean and sample deviation of each metric over the seeds; one seed gives
    a null deviation."""
    aggs = [F.avg(m).alias(f"{m}_mean") for m in metrics]
    aggs += [F.stddev_samp(m).alias(f"{m}_std") for m in metrics]
    return per_state.groupBy(*keys).agg(*aggs)


def mean_std_merge(per_state: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means and deviations side by side; one grouping gives both, so nothing is joined."""
    return grid_mean_std(per_state, keys, metrics)


def weighted_objective(
    metrics: DataFrame, weights: dict[str, float] | None = None, suffix: str = ""
) -> DataFrame:
    """One figure out of several metrics; weights are non-negative and sum to 1."""
    weights = fixed.OBJECTIVE_WEIGHTS if weights is None else weights
    if min(weights.values()) < 0:
        raise ValueError("weights must be non-negative")
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    total = sum((F.col(m + suffix) * w for m, w in weights.items()), F.lit(0.0))
    return metrics.withColumn(f"weighted_primary{suffix}", total)


def guardrails(summary: DataFrame, specs=tuple(fixed.GUARDRAILS), suffix: str = "_mean") -> DataFrame:
    """Only settings that meet every minimum and maximum."""
    for metric, sign, bound in specs:
        col = F.col(metric + suffix)
        if sign == ">=":
            summary = summary.where(col >= bound)
        elif sign == "<":
            summary = summary.where(col < bound)
        else:
            raise ValueError(f"unknown sign {sign!r}")
    return summary

"""Lookups, hand-made labels and set operations on keys.

Sides are broadcast only where a bound is proven. Elsewhere the join carries no
hint: Spark broadcasts by known size, or re-plans at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.functions.codes import no_codes, split_codes
from tagspark.functions.text import blank_to_null

#: The column that says in which part of the records a row lies.
PART = "_part"
# A share of 1/HOT_SHARE of all rows makes a key "hot"; there can be no more
# than HOT_SHARE such keys, which bounds what is broadcast for them.
HOT_SHARE = 10_000


def one_per_key(df: DataFrame, on: str, cols: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, combined before the shuffle.

    With ``order``, the first row by those columns (nulls last); its nulls stay. Without, each column gets
    its smallest value that is not null, so a row with a gap hides no value of another row.
    """
    if order:
        place = [F.struct(F.col(c).isNull(), F.col(c)) for c in (*order, *cols)]
        best = df.groupBy(on).agg(F.min_by(F.struct(*cols), F.struct(*place)).alias("_best"))
        return best.select(on, *[F.col("_best")[c].alias(c) for c in cols])
    return df.groupBy(on).agg(*[F.min(c).alias(c) for c in cols])


def left_lookup(
    df: DataFrame, other: DataFrame, on: str, cols: Sequence[str], where: Column | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Add columns of another table, from the rows that meet ``where`` (see :func:`one_per_key`)."""
    side = other if where is None else other.where(where)
    return df.join(one_per_key(side, on, cols, order), on, "left")


def left_lookup_default(
    df: DataFrame, other: DataFrame, on: str, col: str, default, where: Column | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    out = left_lookup(df, other, on, [col], where, order)
    return out.withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def left_lookup_activities(
    df: DataFrame, other: DataFrame, on: str, cols: Sequence[str] = ("activities",),
    order: Sequence[str] = (),
) -> DataFrame:
    """Texts of another table; blank ones count as missing, so a blank row hides no text."""
    texts = other.withColumns({c: blank_to_null(F.col(c)) for c in cols})
    return left_lookup(df, texts, on, cols, order=order)


def name_join(
    tags: DataFrame,
    records: DataFrame,
    taxonomy: DataFrame,
    id: str = "org_id",
    code: str = "code",
    name: str = "name",
    title: str = "tag",
    title_out: str = "code_name",
) -> DataFrame:
    """Add the record's name and the code's title."""
    titles = taxonomy.select(F.col("code").alias(code), F.col(title).alias(title_out))
    return tags.join(titles, code, "left").join(records.select(id, name), id, "left")


def labels_join(
    records: DataFrame,
    classes: DataFrame,
    taxonomy: DataFrame,
    id: str = "org_id",
    code: str = "class_code",
) -> DataFrame:
    """Records with their class and every taxonomy column of that class."""
    return records.join(classes, id, "left").join(
        taxonomy.withColumnRenamed("code", code), code, "left"
    )


def first_label(
    stacked: DataFrame,
    label_col: str,
    id: str = "org_id",
    order: Sequence[str] = ("file_ord", "row_ord"),
) -> DataFrame:
    """First label per record that is not null, in stacking order."""
    return (
        stacked.where(F.col(label_col).isNotNull())
        .groupBy(id)
        .agg(F.min_by(label_col, F.struct(*order)).alias(label_col))
    )


def override_single(
    pred: DataFrame,
    manual: DataFrame,
    id: str = "org_id",
    code: str = "class_code",
    manual_code: str = "class_code",
) -> DataFrame:
    """A manual code wins: its source is "manual" and its probability null."""
    side = manual.where(F.col(manual_code).isNotNull()).select(
        id, F.col(manual_code).alias("_manual")
    )
    mine = F.col("_manual").isNull()
    joined = pred.join(side, id, "left")
    return joined.withColumns(
        {
            code: F.coalesce("_manual", code),
            f"{code}_probability": F.when(mine, F.col(f"{code}_probability")),
            f"{code}_source": F.when(mine, F.col(f"{code}_source")).otherwise("manual"),
        }
    ).drop("_manual")


def override_multi(
    tags: DataFrame,
    manual: DataFrame,
    mode: str = "replace",
    restrict_to_input: DataFrame | None = None,
    id: str = "org_id",
    manual_codes: str = "tags",
) -> DataFrame:
    """Manual code sets replace (or, with ``append``, join) predicted codes.

    ``restrict_to_input`` names the records to keep manual labels for; by
    default labels of unknown records are added too.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    side = manual.where(F.col(manual_codes).isNotNull())
    if restrict_to_input is not None:
        side = side.join(restrict_to_input.select(id), id, "left_semi")
    kept = tags if mode == "append" else tags.join(side.select(id), id, "left_anti")
    added = side.select(id, F.explode(split_codes(F.col(manual_codes))).alias("code"))
    return kept.select(id, "code").unionByName(added)


def anti_new_rows(new: DataFrame, kept: DataFrame, on: str) -> DataFrame:
    return new.join(kept.select(on), on, "left_anti")


def append_missing(kept: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """Kept rows, then the new ones they lack, in the kept columns."""
    extra = anti_new_rows(new, kept, on)
    extra = extra.select(*[c for c in kept.columns if c in extra.columns])
    return kept.unionByName(extra, allowMissingColumns=True)


def upsert_columns(kept: DataFrame, new: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Fresh values win where there are any, old ones stay otherwise."""
    side = new.select(on, F.struct(*cols).alias("_new"))
    joined = kept.join(side, on, "left")
    fresh = {c: F.coalesce(F.col("_new")[c], F.col(c)) for c in cols}
    return joined.withColumns(fresh).drop("_new")


def semi_member(tags: DataFrame, records: DataFrame, id: str = "org_id") -> DataFrame:
    """Distinct tagged records that exist."""
    return tags.select(id).distinct().join(records.select(id), id, "left_semi")


def intersect_ids(a: DataFrame, b: DataFrame, id: str = "org_id") -> DataFrame:
    return a.select(id).intersect(b.select(id))


def split_overlap(dev: DataFrame, test: DataFrame, id: str = "org_id") -> DataFrame:
    """Records found in both splits; there should be none."""
    return intersect_ids(dev, test, id)


def require_disjoint(dev: DataFrame, test: DataFrame, id: str = "org_id") -> None:
    """Action: fails when two splits share a record."""
    if not split_overlap(dev, test, id).isEmpty():
        raise ValueError("splits share records")


def align_predictions(
    model_eval: DataFrame, rule_eval: DataFrame, id: str = "org_id", by: Sequence[str] = ()
) -> DataFrame:
    """Model rows with rule rows beside them; a missing side is the empty set."""
    keys = [*by, id]
    rules = rule_eval.select(*keys, F.col("predicted_codes").alias("rule_codes"))
    rest = [c for c in model_eval.columns if c not in (*keys, "predicted_codes")]
    return model_eval.join(rules, keys, "left").select(
        *keys,
        *[c for c in rest if c != "prediction_source"],
        F.coalesce("predicted_codes", no_codes()).alias("model_codes"),
        F.coalesce("rule_codes", no_codes()).alias("rule_codes"),
    )


def count_join(
    records: DataFrame, tags: DataFrame, id: str = "org_id", out: str = "n_codes"
) -> DataFrame:
    """Records with their number of tags, 0 when none."""
    counts = tags.groupBy(id).agg(F.count(F.lit(1)).alias(out))
    return records.join(counts, id, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def taxonomy_counts(taxonomy: DataFrame, tags: DataFrame, out: str = "matched") -> DataFrame:
    """Every code with its number of tagged records, 0 when none."""
    counts = tags.groupBy("code").agg(F.count(F.lit(1)).alias(out))
    return taxonomy.join(counts, "code", "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def hot_key_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    rows_per_key: str,
    cols: Sequence[str],
    spread_by: str,
) -> DataFrame:
    """Inner join of a large table with a per-key table of unbounded size.

    ``rows_per_key`` is the number of fact rows of each key. Keys with more
    than 1/HOT_SHARE of all rows (so at most HOT_SHARE keys) are broadcast;
    their fact rows go through the second join under a spread-out key that
    matches nothing, so no task receives a whole hot key.
    """
    total = dim.agg(F.sum(rows_per_key).alias("n"))
    is_hot = F.col(rows_per_key) * HOT_SHARE > total.scalar()
    packed = F.struct(*cols)
    hot = dim.where(is_hot).select(F.col(key), packed.alias("_hot"))
    cold = dim.where(~is_hot).select(F.col(key).alias("_cold_key"), packed.alias("_cold"))
    spread = F.concat(F.lit("\x00"), F.col(spread_by).cast("string"))
    marked = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_join_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread)
    )
    joined = marked.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    found = F.coalesce("_hot", "_cold")
    out = joined.where(found.isNotNull())
    return out.select(*facts.columns, *[found[c].alias(c) for c in cols])


def in_parts(df: DataFrame, id: str = "org_id") -> DataFrame:
    """All rows of a record in one part, which ``PART`` numbers: rows that lie so already stay, others travel once.

    Grouping, windows and joins by ``PART`` and record then need no shuffle. There are as many parts as shuffle partitions.
    """
    if PART in df.columns:
        return df
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(PART, F.pmod(F.xxhash64(id), F.lit(n)).cast("int")).repartitionById(n, F.col(PART))


def answers_to_parts(answers: DataFrame) -> DataFrame:
    """Rows carried to the part that they name, beside the rows that :func:`in_parts` laid there."""
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return answers.repartitionById(n, F.col(PART)).hint("shuffle_hash")


def part_join(facts: DataFrame, dim: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Inner join of rows that lie in parts with a per-key table of unbounded size; the rows stay where they are.

    Each part asks once for each of its keys, and the answers go to the part. So a key that stands in every record
    travels as often as there are parts, and no task receives the rows of a hot key.
    """
    asked = facts.select(PART, key).distinct()
    return facts.join(answers_to_parts(asked.join(dim.select(key, *cols), key)), [PART, key]).select(*facts.columns, *cols)

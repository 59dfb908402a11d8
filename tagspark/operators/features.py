"""Terms, weights and scores in long form: one row per record and term.

Long form has no size limit: vocabularies are never gathered. Fitting uses the
vector form in ``tagspark.operators.models`` instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagspark.functions.codes import explode_rows, split_codes
from tagspark.operators.joins import PART, answers_to_parts, in_parts, part_join
from tagspark.operators.term_lists import term_lists

# Coefficients that are broadcast at a time in a score join.
BLOCK_COEFS = 2_000_000


def term_counts(
    df: DataFrame, tokens_col: str, min_df: int = 1, id: str = "org_id", keep_part: bool = False
) -> DataFrame:
    """``(id, term, tf, df)`` for terms found in at least ``min_df`` records.

    The lists of tokens travel once, to lie by record; counting, and what is done with the terms afterwards, stays there. Each part sends
    each of its terms once to be counted over all parts. With ``keep_part`` the result has the column ``PART``, by which
    :func:`tfidf_l2` and the others know that rows lie by record. Without, the rows are those of ``term_lists``.
    """
    if not keep_part:
        rows = explode_rows(term_lists(df, tokens_col, min_df, id), [id], "terms", "_t")
        return rows.select(id, *[F.col(f"_t.{c}").alias(c) for c in ("term", "tf", "df")])
    lists = in_parts(df.select(id, tokens_col), id)
    counts = explode_rows(lists, [PART, id], tokens_col, "term").groupBy(PART, id, "term").agg(F.count(F.lit(1)).alias("tf"))
    # Asking for tf keeps both uses of ``counts`` alike.
    own = counts.groupBy(PART, "term").agg(F.count_if(F.col("tf") > 0).alias("_n"))
    # a term has as many rows as there are parts at most
    found = own.withColumn("df", F.sum("_n").over(Window.partitionBy("term"))).where(F.col("df") >= min_df)
    out = counts.join(answers_to_parts(found.select(PART, "term", "df")), [PART, "term"])
    return out.select(PART, id, "term", "tf", "df")


def tfidf_l2(counts: DataFrame, n_records: DataFrame, id: str = "org_id") -> DataFrame:
    """``tf * (ln((1+n)/(1+df)) + 1)``, scaled to length 1 per record.

    ``n_records`` has one row with the number of records, empty ones included. Counts in parts give weights in parts.
    """
    n = n_records.scalar()
    raw = F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)
    weighted = counts.withColumn("_raw", raw)
    part = _part_of(counts)
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*part, id)))
    return weighted.select(*part, id, "term", (F.col("_raw") / length).alias("weight"))


def _part_of(rows: DataFrame) -> list[str]:
    return [PART] if PART in rows.columns else []


def label_binarise(gold: DataFrame, tags: str = "tags", id: str = "org_id") -> DataFrame:
    """One row per record and label it has; a 0 is a missing row."""
    return gold.select(id, F.explode(F.array_distinct(split_codes(F.col(tags)))).alias("label"))


def class_weights(labels: DataFrame, n_records: DataFrame, mode: str = "balanced") -> DataFrame:
    """Weight of positive and negative rows of every label's own model."""
    if mode not in ("none", "balanced"):
        raise ValueError(f"unknown class weight mode {mode!r}")
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    n = n_records.scalar().cast("double")
    if mode == "none":
        pos = neg = F.lit(1.0)
    else:
        pos = n / (2 * F.col("n_label"))
        neg = n / F.nullif(2 * (n - F.col("n_label")), F.lit(0.0))
    return counts.select("label", "n_label", pos.alias("positive"), neg.alias("negative"))


def score_lists(
    terms: DataFrame,
    coefs: DataFrame,
    intercepts: Mapping[str, float],
    link: str = "sigmoid",
    records: DataFrame | None = None,
    id: str = "org_id",
) -> DataFrame:
    """``(id, ranked)``: the scores of a record's labels in one list, best first, as decisions read them.

    ``terms`` is ``(id, term, weight)``, ``coefs`` is ``(term, code, coef)``. Scores are probabilities
    (``sigmoid``) or ``margin``. Records without a known term score by the intercept alone; pass
    ``records`` so that those without any term are kept too.

    Coefficients meet the terms in broadcasts of at most ``BLOCK_COEFS`` each, one after the other, so terms
    stay where they are, however frequent one is, and sums by record need no shuffle if terms lie by record.
    Action: counts ``coefs``.
    """
    if link not in ("sigmoid", "margin"):
        raise ValueError(f"unknown link {link!r}")
    blocks = max(1, -(-coefs.count() // BLOCK_COEFS))
    packed = coefs.groupBy("term").agg(F.collect_list(F.struct("code", "coef")).alias("_c"))
    hits = terms
    for i in range(blocks):
        own = packed if blocks == 1 else packed.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i)
        hits = hits.join(F.broadcast(own.withColumnRenamed("_c", f"_c{i}")), "term", "left")
    met = F.coalesce(*[f"_c{i}" for i in range(blocks)])
    part = _part_of(terms)
    if records is not None:
        hits = hits.where(met.isNotNull())  # the others add nothing, and their records are among ``records``
    rows = hits.select(*part, id, "weight", F.explode_outer(met).alias("_x"))
    sums = rows.groupBy(*part, id, F.col("_x.code").alias("code")).agg(F.sum(F.col("weight") * F.col("_x.coef")).alias("_sum"))
    found = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "_sum")))
    lists = sums.groupBy(*part, id).agg(F.map_from_entries(found).alias("_sums")).drop(PART)
    if records is not None:
        lists = records.select(id).join(lists, id, "left")
    starts = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(float(b)).alias("b")) for c, b in sorted(intercepts.items())])

    def scored(start):
        margin = start["b"] + F.coalesce(F.try_element_at("_sums", start["code"]), F.lit(0.0))
        value = margin if link == "margin" else 1.0 / (1.0 + F.exp(-margin))
        return F.struct((-value).alias("neg"), start["code"].alias("code"))

    return lists.select(id, F.array_sort(F.transform(starts, scored)).alias("ranked"))


def score_labels(
    terms: DataFrame,
    coefs: DataFrame,
    intercepts: Mapping[str, float],
    link: str = "sigmoid",
    records: DataFrame | None = None,
    id: str = "org_id",
) -> DataFrame:
    """The lists of :func:`score_lists` as rows: ``(id, code, score)``."""
    rows = explode_rows(score_lists(terms, coefs, intercepts, link, records, id), [id], "ranked", "_s")
    return rows.select(id, F.col("_s.code").alias("code"), (-F.col("_s.neg")).alias("score"))


def naive_bayes_sql(
    train_terms: DataFrame,
    train_labels: DataFrame,
    test_terms: DataFrame,
    alpha: float = 1.0,
    id: str = "org_id",
    label: str = "label",
    value: str = "tf",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Multinomial naive Bayes by counting: ``(id, code, score)`` log scores.

    A term that a class never saw has a count of 0, so its log probability is
    ``ln(alpha) - ln(total)``. Only seen pairs are joined; the share of unseen
    ones comes from the record's own number of known terms. Terms that do not lie in parts are laid by record first;
    from there on only the vocabulary of each part travels.
    """
    keys = list(by)
    test_terms = in_parts(test_terms, id)
    rows = in_parts(train_terms, id).join(answers_to_parts(in_parts(train_labels, id)), [PART, id])
    seen = rows.groupBy(*keys, label, "term").agg(F.sum(value).alias("_c"))
    vocabulary = seen.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("_x"))
    size = vocabulary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v")) if keys else None
    per_class = seen.groupBy(*keys, label).agg(F.sum("_c").alias("_total"))
    docs = train_labels.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_d"))
    classes = docs.join(per_class, [*keys, label])
    if keys:
        n_docs = docs.groupBy(*keys).agg(F.sum("_d").alias("_n"))
        classes = classes.join(size, keys).join(n_docs, keys)
    else:
        v = vocabulary.agg(F.count(F.lit(1)).alias("v")).scalar()
        n = docs.agg(F.sum("_d").alias("n")).scalar()
        classes = classes.withColumn("_v", v).withColumn("_n", n)
    floor = F.col("_total") + alpha * F.col("_v")
    classes = classes.select(
        *keys,
        label,
        F.log(F.col("_d") / F.col("_n")).alias("_prior"),
        F.log(floor).alias("_log_floor"),
    )
    # Weight of each seen (class, term) above the unseen level.
    lift = seen.select(*keys, label, "term", "_c", (F.log(F.col("_c") + alpha) - F.log(F.lit(alpha))).alias("_lift"))
    packed = lift.groupBy(*keys, "term").agg(F.collect_list(F.struct(F.col(label).alias("code"), "_lift")).alias("_lifts"))
    if keys:
        name = F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys], "term")
    else:
        name = F.col("term")
    known = part_join(test_terms.withColumn("_term_key", name), packed.withColumn("_term_key", name), "_term_key", ["_lifts"])
    # One more entry beside the classes adds up the record's own mass.
    own = F.struct(F.lit(None).cast(lift.schema[label].dataType).alias("code"), F.lit(1.0).alias("_lift"))
    rows = known.select(PART, *keys, id, value, F.explode(F.concat("_lifts", F.array(own))).alias("_l"))
    sums = rows.groupBy(PART, *keys, id, F.col("_l.code").alias("code")).agg(F.sum(F.col(value) * F.col("_l._lift")).alias("_s"))
    lifted = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "_s")))
    mass = F.sum(F.when(F.col("code").isNull(), F.col("_s")))
    records = sums.groupBy(PART, *keys, id).agg(F.map_from_entries(lifted).alias("_lifted"), mass.alias("_mass"))
    listed = F.collect_list(F.struct(F.col(label).alias("code"), "_prior", "_log_floor"))
    if keys:
        spread = records.join(classes.groupBy(*keys).agg(listed.alias("_cls")), keys)
    else:
        spread = records.withColumn("_cls", classes.agg(listed.alias("c")).scalar())
    score = F.col("_x._prior") + F.coalesce(F.try_element_at("_lifted", F.col("_x.code")), F.lit(0.0)) + F.col("_mass") * (
        F.log(F.lit(alpha)) - F.col("_x._log_floor")
    )
    frame = spread.select(*keys, id, "_mass", "_lifted", F.explode("_cls").alias("_x"))
    return frame.select(*keys, id, F.col("_x.code").alias("code"), score.alias("score"))

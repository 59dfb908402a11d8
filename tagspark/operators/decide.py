"""From scores to code sets, and from two code sets to one.

Scores of a record are gathered into one list, best first (as many entries as
there are labels), and every decision is then made inside the row: no window,
no second shuffle, and the same expressions serve batch and streaming input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.codes import no_codes, union_codes

FALLBACK_MODES = ("none", "top_k", "max_score_top_1")
HYBRID_RULES = ("ovr_regex_fallback", "high_conf_union", "label_conf_gated_regex")


def ranked_scores(
    scores: DataFrame, id: str = "org_id", by: Sequence[str] = (), out: str = "ranked"
) -> DataFrame:
    """Per record, its scores as a list: highest first, then by code; lists pass as they are."""
    if "ranked" in scores.columns:
        return scores.withColumnRenamed("ranked", out)
    item = F.struct((-F.col("score")).alias("neg"), F.col("code").alias("code"))
    return scores.groupBy(*by, id).agg(F.array_sort(F.collect_list(item)).alias(out))


def _codes(items: Column) -> Column:
    return F.array_sort(F.transform(items, lambda x: x["code"]))


def decided(
    ranked: Column,
    threshold: Column | float,
    mode: Column | str = "none",
    k: Column | int = 0,
    min_score: Column | float = 0.0,
) -> Column:
    """Codes at or above the threshold; if none, what the fallback allows.

    Settings may be columns, so that many of them can be tried in one pass.
    """
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    passed = _codes(F.filter(ranked, lambda x: -x["neg"] >= col(threshold)))
    best = F.slice(ranked, F.lit(1), F.greatest(col(k).cast("int"), F.lit(0)))
    single = F.filter(F.slice(ranked, 1, 1), lambda x: -x["neg"] >= col(min_score))
    fallback = (
        F.when(col(mode) == "top_k", _codes(best))
        .when(col(mode) == "max_score_top_1", _codes(single))
        .otherwise(no_codes())
    )
    return F.when(F.size(passed) > 0, passed).otherwise(fallback)


def _decide(scores: DataFrame, id: str, **how) -> DataFrame:
    return ranked_scores(scores, id).select(id, decided(F.col("ranked"), **how).alias("predicted_codes"))


def decide_threshold(scores: DataFrame, threshold: float, id: str = "org_id") -> DataFrame:
    return _decide(scores, id, threshold=threshold)


def decide_top_k(scores: DataFrame, threshold: float, k: int, id: str = "org_id") -> DataFrame:
    """If no label passes, the ``k`` best."""
    return _decide(scores, id, threshold=threshold, mode="top_k", k=k)


def decide_max_score(
    scores: DataFrame, threshold: float, min_score: float, id: str = "org_id"
) -> DataFrame:
    """If no label passes, the best one when it reaches ``min_score``."""
    return _decide(scores, id, threshold=threshold, mode="max_score_top_1", min_score=min_score)


def combined(
    model_codes: Column,
    rule_codes: Column,
    ranked: Column,
    rule: str,
    max_labels: int = fixed.HYBRID_MAX_LABELS,
    row_conf: float = fixed.HYBRID_ROW_CONFIDENCE,
    label_conf: Column | float = fixed.HYBRID_LABEL_CONFIDENCE,
) -> Column:
    """Model codes, widened by rule codes where the hybrid rule allows it."""
    if rule == "ovr_regex_fallback":
        return F.when(F.size(model_codes) <= max_labels, union_codes(model_codes, rule_codes)).otherwise(model_codes)
    if rule == "high_conf_union":
        best = F.coalesce(-F.get(ranked, F.lit(0))["neg"], F.lit(0.0))
        return F.when(best >= row_conf, union_codes(model_codes, rule_codes)).otherwise(model_codes)
    if rule == "label_conf_gated_regex":
        gate = label_conf if isinstance(label_conf, Column) else F.lit(label_conf)

        def score_of(code: Column) -> Column:
            own = F.get(F.filter(ranked, lambda x: x["code"] == code), F.lit(0))
            return F.coalesce(-own["neg"], F.lit(0.0))

        return union_codes(model_codes, F.filter(rule_codes, lambda c: score_of(c) >= gate))
    raise ValueError(f"unknown hybrid rule {rule!r}")


def combine_hybrid(
    aligned: DataFrame, ranked: DataFrame | None, rule: str, id: str = "org_id", **how
) -> DataFrame:
    """Hybrid evaluation rows out of aligned model and rule sets."""
    rows = aligned
    if "ranked" not in rows.columns:
        if ranked is None:
            rows = rows.withColumn("ranked", F.lit(None).cast("array<struct<neg:double,code:string>>"))
        else:
            rows = rows.join(ranked.select(id, "ranked"), id, "left")
    final = combined(F.col("model_codes"), F.col("rule_codes"), F.col("ranked"), rule, **how)
    rest = [c for c in aligned.columns if c not in ("model_codes", "rule_codes", "ranked")]
    return rows.select(
        *rest, final.alias("predicted_codes"), F.lit(f"hybrid_{rule}").alias("prediction_source")
    )


def hybrid_fallback(aligned: DataFrame, max_labels: int = fixed.HYBRID_MAX_LABELS) -> DataFrame:
    """Add rule codes when the model gave few labels."""
    return combine_hybrid(aligned, None, "ovr_regex_fallback", max_labels=max_labels)


def hybrid_high_conf(
    aligned: DataFrame, scores: DataFrame | None = None, row_conf: float = fixed.HYBRID_ROW_CONFIDENCE
) -> DataFrame:
    """Add rule codes when the record's best score is high enough; rows may carry ``ranked`` themselves."""
    lists = None if scores is None else ranked_scores(scores)
    return combine_hybrid(aligned, lists, "high_conf_union", row_conf=row_conf)


def hybrid_gated(
    aligned: DataFrame, scores: DataFrame | None = None, label_conf: float = fixed.HYBRID_LABEL_CONFIDENCE
) -> DataFrame:
    """Add each rule code whose own score is high enough; an unknown one scores 0."""
    lists = None if scores is None else ranked_scores(scores)
    return combine_hybrid(aligned, lists, "label_conf_gated_regex", label_conf=label_conf)


def tag_restricted_class(
    scores: DataFrame, candidates: DataFrame, id: str = "org_id"
) -> DataFrame:
    """Best class among the candidates of a record's tags; all classes if none.

    Notes how it was found, how many classes were open, and the free choice.
    """
    lists = ranked_scores(scores, id).join(candidates.select(id, "candidates"), id, "left")
    allowed = F.coalesce("candidates", no_codes())
    narrowed = F.filter("ranked", lambda x: F.array_contains(allowed, x["code"]))
    rows = lists.select(id, "ranked", narrowed.alias("_open"))
    n = F.size("_open")
    chosen = F.when(n > 0, F.get("_open", F.lit(0))).otherwise(F.get("ranked", F.lit(0)))
    free = F.get("ranked", F.lit(0))
    return rows.select(
        id,
        chosen["code"].alias("class_code"),
        (-chosen["neg"]).alias("score"),
        F.when(n == 1, "only_one_tag").when(n == 0, "all_classes").otherwise("ranked_tags").alias("source"),
        F.when(n > 0, n).otherwise(F.size("ranked")).alias("source_count"),
        free["code"].alias("original_class_code"),
        (-free["neg"]).alias("original_max_score"),
    )

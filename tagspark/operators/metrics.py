"""Quality of predicted code sets and of single classes.

Each function reads its input once. Rows become small per-code counters that
are combined per task, so the shuffle carries groups x codes rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 when there is nothing to divide by."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def _label_cells(truth: Column, pred: Column) -> Column:
    """One counter per code that is true or predicted."""
    def cell(code: Column) -> Column:
        t, p = F.array_contains(truth, code), F.array_contains(pred, code)
        return F.struct(
            code.alias("code"),
            (t & p).cast("int").alias("tp"),
            (~t & p).cast("int").alias("fp"),
            (t & ~p).cast("int").alias("fn"),
        )

    return F.transform(F.array_union(truth, pred), cell)


def per_label_prf(eval_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every code."""
    cells = eval_rows.select(*by, F.explode(_label_cells(F.col("true_codes"), F.col("predicted_codes"))).alias("_c"))
    counts = cells.groupBy(*by, F.col("_c.code").alias("code")).agg(
        *[F.sum(f"_c.{k}").alias(k) for k in ("tp", "fp", "fn")]
    )
    p, r, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        *by, "code", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1")
    )


def multilabel_metrics(eval_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores of code sets over the codes that are true or predicted anywhere.

    Row-level sums travel as one more counter under the null code, so labels
    and rows are counted in the same pass.
    """
    t, p = F.col("true_codes"), F.col("predicted_codes")
    both, either = F.size(F.array_intersect(t, p)), F.size(F.array_union(t, p))
    row = F.struct(
        F.lit(None).cast("string").alias("code"),
        F.lit(0).alias("tp"),
        F.lit(0).alias("fp"),
        F.lit(0).alias("fn"),
        F.lit(1).alias("rows"),
        (both == either).cast("int").alias("exact"),
        _ratio(both.cast("double"), either).alias("jaccard"),
    )
    cells = F.transform(
        _label_cells(t, p),
        lambda c: F.struct(
            c["code"].alias("code"),
            c["tp"].alias("tp"),
            c["fp"].alias("fp"),
            c["fn"].alias("fn"),
            F.lit(0).alias("rows"),
            F.lit(0).alias("exact"),
            F.lit(0.0).alias("jaccard"),
        ),
    )
    long = eval_rows.select(*by, F.explode(F.concat(F.array(row), cells)).alias("_c"))
    return metrics_of_counts(long.select(*by, "_c.*"), by)


def metrics_of_counts(counters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics out of counters (code, tp, fp, fn, rows, exact, jaccard)."""
    sums = ("tp", "fp", "fn", "rows", "exact", "jaccard")
    labels = counters.groupBy(*by, "code").agg(*[F.sum(s).alias(s) for s in sums])
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    _, _, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    is_label = F.col("code").isNotNull()
    totals = labels.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        tp.alias("_tp"),
        fp.alias("_fp"),
        fn.alias("_fn"),
        F.coalesce(F.avg(F.when(is_label, f1)), F.lit(0.0)).alias("f1_macro"),
        F.count_if(is_label).alias("_labels"),
        F.sum("exact").alias("_exact"),
        F.sum("jaccard").alias("_jaccard"),
    )
    p, r, f = _prf(F.col("_tp"), F.col("_fp"), F.col("_fn"))
    return totals.select(
        *by,
        "rows",
        p.alias("precision_micro"),
        r.alias("recall_micro"),
        f.alias("f1_micro"),
        "f1_macro",
        _ratio(F.col("_exact"), F.col("rows")).alias("subset_accuracy"),
        _ratio(F.col("_jaccard"), F.col("rows")).alias("jaccard_samples"),
        _ratio(F.col("_fp") + F.col("_fn"), F.col("rows") * F.col("_labels")).alias("hamming_loss"),
    )


def multiclass_metrics(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), report: bool = False
) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and weighted F1.

    With ``report``, also weighted precision and recall, and ``classes``: precision, recall, F1 and support of every class that is true
    or predicted, in order of the code (null last), 0 where there is nothing to divide by.
    """
    t, p = F.col(truth), F.col(pred)
    hit = t.eqNullSafe(p).cast("int")
    cells = F.array(
        F.struct(t.alias("code"), hit.alias("tp"), F.lit(1).alias("true"), F.lit(0).alias("pred")),
        F.struct(p.alias("code"), F.lit(0).alias("tp"), F.lit(0).alias("true"), F.lit(1).alias("pred")),
    )
    labels = (
        df.select(*by, F.explode(cells).alias("_c"))
        .groupBy(*by, F.col("_c.code").alias("code"))
        .agg(*[F.sum(f"_c.{k}").alias(k) for k in ("tp", "true", "pred")])
    )
    tp, n_true, n_pred = F.col("tp"), F.col("true"), F.col("pred")
    precision, recall = _ratio(tp, n_pred), _ratio(tp, n_true)
    f1 = _ratio(2 * tp, n_true + n_pred)
    more = []
    if report:
        each = F.struct(F.col("code").isNull().alias("none"), "code", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), n_true.alias("support"))
        fields = ("code", "precision", "recall", "f1", "support")
        more = [
            (F.sum(precision * n_true) / F.sum(n_true)).alias("precision_weighted"),
            (F.sum(recall * n_true) / F.sum(n_true)).alias("recall_weighted"),
            F.transform(F.array_sort(F.collect_list(each)), lambda c: F.struct(*[c[k].alias(k) for k in fields])).alias("classes"),
        ]
    return labels.groupBy(*by).agg(
        F.sum(n_true).alias("rows"),
        (F.sum(tp) / F.sum(n_true)).alias("accuracy"),
        F.avg(precision).alias("precision_macro"),
        F.avg(recall).alias("recall_macro"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * n_true) / F.sum(n_true)).alias("f1_weighted"),
        *more,
    )

"""End-to-end jobs over whole registers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark import fixed
from tagspark.functions.codes import band, explode_rows
from tagspark.functions.text import flatten_newlines, regnumber_to_orgid, text_corpus
from tagspark.operators import aggregates, decide, joins, models, ranking, registry, rules
from tagspark.plans import registers
from tagspark.sources.readers import records_to_table


def job_unify(
    registers: Sequence[DataFrame], top_kept: DataFrame | None = None,
    n_top: int = fixed.LARGEST_RECORDS,
) -> dict[str, DataFrame]:
    """Registers in the unified columns to one table, its active and inactive
    parts, and the refreshed list of the largest active records."""
    unified = flatten_newlines(registry.union_registers(*registers), ["activities", "objects"])
    active = F.coalesce(F.col("active"), F.lit(False))
    out = {"all": unified, "active": unified.where(active), "inactive": unified.where(~active)}
    if top_kept is not None:
        largest = ranking.top_n_by_income(out["active"], n_top)
        listed = joins.append_missing(top_kept, largest, "org_id")
        shared = [c for c in top_kept.columns if c in unified.columns and c != "org_id"]
        fresh = joins.upsert_columns(listed, unified, "org_id", shared)
        out["top"] = ranking.sort_output(fresh, ["org_id"])
    return out


def job_unify_raw(
    raw: Mapping[str, Mapping[str, DataFrame]], top_kept: DataFrame | None = None,
    n_top: int = fixed.LARGEST_RECORDS, as_of=None,
) -> dict[str, DataFrame]:
    """The same from raw registers: source -> its tables by name, the register itself under ``main``."""
    tables = [
        registers.unified(registers.REGISTERS[source], parts["main"], parts, as_of) for source, parts in raw.items()
    ]
    return job_unify(tables, top_kept, n_top)


def _finished(tags: DataFrame, records: DataFrame, taxonomy: DataFrame | None, ordered: bool) -> DataFrame:
    out = tags.distinct()
    if taxonomy is not None:
        out = joins.name_join(out, records, taxonomy)
    return out.orderBy("org_id", "code") if ordered else out


def _with_manual(tags: DataFrame, manual: DataFrame | None, mode: str) -> DataFrame:
    return tags if manual is None else joins.override_multi(tags, manual, mode)


def job_tag_rules(
    records: DataFrame, rule_list: Sequence[rules.Rule], manual: DataFrame | None = None,
    include_groups: bool = False, taxonomy: DataFrame | None = None,
    fields: Sequence[str] = fixed.DEFAULT_FIELDS, manual_mode: str = "replace",
    ordered: bool = True,
) -> DataFrame:
    """Rules, manual codes, parents, distinct rows, names.

    ``manual`` is the result of ``first_label``. ``ordered=False`` leaves out
    the global sort, which a large table rarely needs.
    """
    tags = rules.tag_by_rules(text_corpus(records, fields), rule_list)
    tags = _with_manual(tags, manual, manual_mode)
    if include_groups:
        tags = rules.expand_groups(tags)
    return _finished(tags, records, taxonomy, ordered)


def job_tag_ovr(
    records: DataFrame, model: models.OvrModel, manual: DataFrame | None = None,
    include_groups: bool = False, taxonomy: DataFrame | None = None,
    manual_mode: str = "replace", ordered: bool = True,
) -> DataFrame:
    """The same with the codes of a fitted model, by its own saved settings."""
    rows = model.predict(text_corpus(records, model.settings.fields))
    tags = explode_rows(rows, ["org_id"], "predicted_codes", "code")
    tags = _with_manual(tags, manual, manual_mode)
    if include_groups:
        tags = rules.expand_groups(tags)
    return _finished(tags, records, taxonomy, ordered)


def job_tag_hybrid(
    records: DataFrame, rule_list: Sequence[rules.Rule], model: models.OvrModel,
    manual: DataFrame | None = None, taxonomy: DataFrame | None = None,
    hybrid_rule: str | None = None, label_conf: float | None = None,
    manual_mode: str = "replace", ordered: bool = True,
) -> DataFrame:
    """Rules (with parents if the model's settings say so) and model, combined.

    Rules and model read the same row, so both code sets are made in one
    narrow pass and never joined.
    """
    s = model.settings
    sets = rules.tag_sets(
        text_corpus(records, s.fields), rule_list, include_groups=s.include_groups, out="rule_codes"
    )
    rows = model.predict(sets, keep=["org_id", "rule_codes"])
    conf = label_conf if label_conf is not None else s.hybrid_conf
    final = decide.combined(
        F.col("predicted_codes"), F.col("rule_codes"), F.col("ranked"),
        hybrid_rule or s.hybrid_rule or "label_conf_gated_regex",
        label_conf=fixed.HYBRID_LABEL_CONFIDENCE if conf is None else conf,
    )
    tags = explode_rows(rows, ["org_id"], final, "code")
    return _finished(_with_manual(tags, manual, manual_mode), records, taxonomy, ordered)


def job_classify(
    records: DataFrame, model: models.ClassModel, manual: DataFrame | None = None,
    classes: DataFrame | None = None, fields: Sequence[str] = fixed.DEFAULT_FIELDS,
    ordered: bool = True,
) -> DataFrame:
    """One class per record with its probability; manual classes win; titles."""
    best = model.predict(text_corpus(records, fields))
    pred = best.select(
        "org_id", "class_code",
        F.bround("class_code_probability", 3).alias("class_code_probability"),
        F.lit("ml_model").alias("class_code_source"),
    )
    if manual is not None:
        pred = joins.override_single(pred, manual)
    if classes is not None:
        titles = aggregates.taxonomy_code(classes)
        pred = joins.name_join(pred, records, titles, code="class_code", title="title",
                               title_out="class_name")
    return _finished_class(pred, ordered)


def _finished_class(pred: DataFrame, ordered: bool) -> DataFrame:
    out = pred.distinct()
    return out.orderBy("org_id", "class_code") if ordered else out


def job_gold_sample(raw: DataFrame, schema, list_fields: Sequence[str] = ("tags", "class_code")) -> DataFrame:
    """Hand-labelled JSON records to the gold table, ids made from register numbers."""
    table = records_to_table(raw, schema, list_fields).drop("id")
    table = flatten_newlines(table, ["activities", "objects"])
    with_id = table.withColumn("org_id", regnumber_to_orgid(F.col("reg_number")))
    first = ["org_id", *[c for c in table.columns if c != "org_id"]]
    return with_id.select(*first).orderBy("org_id")


def job_taxonomy(raw: DataFrame, schema, keep: Sequence[str], unused: str = "not_used",
                 order: str = "full_name") -> DataFrame:
    """Taxonomy JSON records to the table of rules in use."""
    table = records_to_table(raw, schema, ["related"])
    return aggregates.taxonomy_prune(table.orderBy(order), unused, keep)


def job_report(
    records: DataFrame, tags: DataFrame, taxonomy: DataFrame, seed: int = fixed.SEED,
    n: int = 10, show: Sequence[str] = ("name", "income", "source"),
) -> dict[str, DataFrame]:
    """Tables behind one page per code: distributions, largest and random records.

    Tags meet records once for all codes.
    """
    banded = records.withColumn(
        "income_band", band(F.col("income"), fixed.INCOME_EDGES, fixed.INCOME_LABELS)
    )
    members = aggregates.prefix_match(tags, taxonomy).join(
        records.select("org_id", *show), "org_id"
    )
    return {
        "levels": aggregates.taxonomy_levels(taxonomy),
        "distributions": aggregates.category_report(banded, tags, taxonomy, ["income_band", "source"]),
        "largest": ranking.top_n_per_code(members, n),
        "random": ranking.sample_n_per_code(members, n, seed, n),
    }

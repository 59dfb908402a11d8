"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _DT = T.StringType(), T.DoubleType(), T.BooleanType(), T.DateType()


def _of(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


RECORDS = _of(
    org_id=_S, reg_number=_S, name=_S, postcode=_S, active=_B, date_registered=_DT,
    date_removed=_DT, web=_S, company_number=_S, activities=_S, objects=_S, source=_S,
    last_updated=_DT, income=_D, spending=_D, fye=_DT, grant_making_is_main_activity=_B,
)
# Hand-labelled records: ``tags`` is a ``;`` list, ``class_code`` a single code.
GOLD = _of(
    org_id=_S, reg_number=_S, name=_S, postcode=_S, active=_B, date_registered=_DT,
    activities=_S, objects=_S, source=_S, income=_D, spending=_D, fye=_DT, batch_id=_S,
    web=_S, company_number=_S, tags=_S, class_code=_S,
)
MANUAL = _of(org_id=_S, tags=_S, class_code=_S)
RULES = _of(
    code=_S, tag=_S, category=_S, subcategory=_S, level=T.IntegerType(), notes=_S,
    related=_S, include=_S, exclude=_S,
)
CLASSES = _of(section=_S, group=_S, sub_group=_S, title=_S, notes=_S)
TAGS = _of(org_id=_S, code=_S)
SCORES = _of(org_id=_S, code=_S, score=_D)
EVAL = T.StructType(
    [
        T.StructField("org_id", _S),
        T.StructField("true_codes", T.ArrayType(_S)),
        T.StructField("predicted_codes", T.ArrayType(_S)),
        T.StructField("prediction_source", _S),
    ]
)
SPLIT_INFO = _of(
    seed=T.IntegerType(), test_size=_D, labelled_rows=T.LongType(), dev_rows=T.LongType(),
    test_rows=T.LongType(),
)
BEST_SETTINGS = _of(
    approach=_S, selected_by=_S, fields_key=_S, clean_text=_B, model_family=_S, threshold=_D,
    ngram_max=T.IntegerType(), char_ngram_max=T.IntegerType(), model_c=_D, sgd_loss=_S,
    sgd_alpha=_D, class_weight_mode=_S, fallback_mode=_S, fallback_min_score=_D,
    top_k_fallback=T.IntegerType(), include_groups=_B, hybrid_rule=_S, hybrid_conf=_D,
)

"""From differently shaped registers to one record table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark import schema

_TYPES = {f.name: f.dataType for f in schema.RECORDS.fields}


def filter_main_entity(df: DataFrame, col: str = "linked_charity_number") -> DataFrame:
    return df.where(F.col(col) == 0)


def active_flag(rule: str, col: Column, value: str | None = None) -> Column:
    """``equals`` a status, ``is_null`` (no removal date), or ``differs`` from a
    status, where a missing status counts as active."""
    if rule == "equals":
        return F.coalesce(col == value, F.lit(False))
    if rule == "is_null":
        return col.isNull()
    if rule == "differs":
        return ~col.eqNullSafe(value)
    raise ValueError(f"unknown rule {rule!r}")


def derive_active(df: DataFrame, rule: str, col: str, value: str | None = None) -> DataFrame:
    return df.withColumn("active", active_flag(rule, F.col(col), value))


def build_org_id(df: DataFrame, reg_col: str, prefix: str) -> DataFrame:
    return df.withColumn("org_id", F.concat(F.lit(prefix), F.col(reg_col).cast("string")))


def conform_registry(
    df: DataFrame, mapping: Mapping[str, str | Column], constants: Mapping[str, object] | None = None
) -> DataFrame:
    """The unified columns: renamed or computed from ``mapping``, fixed from
    ``constants``, null where neither names one."""
    constants = constants or {}
    out = []
    for name, kind in _TYPES.items():
        if name in mapping:
            source = mapping[name]
            value = F.col(source) if isinstance(source, str) else source
        else:
            value = F.lit(constants.get(name))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def union_registers(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)

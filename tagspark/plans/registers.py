"""The three public registers: which raw columns make the unified ones, as data, and one way to read them all."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagspark.functions.text import postcode_from_address
from tagspark.operators import joins, registry


@dataclass(frozen=True)
class Lookup:
    """Columns that come from a second raw table, by the register's number."""

    table: str
    key: str
    main_entity: str | None = None  # rows count only where this column is 0
    where: str | None = None  # rows count only where this column is true
    default: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Register:
    source: str
    id_prefix: str
    number: str  # raw column of the register's number
    columns: Mapping[str, str]  # unified column -> raw column
    active: tuple[str, str, str | None]  # rule, raw column, status
    number_prefix: str = ""
    main_entity: str | None = None
    address: str | None = None  # raw column whose last part is the postcode
    lookups: tuple[Lookup, ...] = ()
    dated: bool = False  # the raw table has no date of its own


# --- fixed values: column names, prefixes and statuses of the raw registers -----
CCEW = Register(
    source="ccew", id_prefix="GB-CHC-", number="registered_charity_number", main_entity="linked_charity_number",
    active=("equals", "charity_registration_status", "Registered"),
    columns={
        "name": "charity_name", "postcode": "charity_contact_postcode", "date_registered": "date_of_registration",
        "date_removed": "date_of_removal", "web": "charity_contact_web", "company_number": "charity_company_registration_number",
        "activities": "charity_activities", "objects": "charitable_objects", "last_updated": "date_of_extract",
        "income": "latest_income", "spending": "latest_expenditure", "fye": "latest_acc_fin_period_end_date",
        "grant_making_is_main_activity": "grant_making_is_main_activity",
    },
    lookups=(
        Lookup("governing_document", "registered_charity_number", main_entity="linked_charity_number"),
        Lookup("annual_return_part_a", "registered_charity_number", where="latest_fin_period_submitted_ind", default={"grant_making_is_main_activity": False}),
    ),
)
OSCR = Register(
    source="oscr", id_prefix="GB-SC-", number="Charity Number", active=("is_null", "Ceased Date", None), dated=True,
    columns={
        "name": "Charity Name", "postcode": "Postcode", "date_registered": "Registered Date", "date_removed": "Ceased Date",
        "web": "Website", "objects": "Objectives", "income": "Most recent year income",
        "spending": "Most recent year expenditure", "fye": "Year End",
    },
)
CCNI = Register(
    source="ccni", id_prefix="GB-NIC-", number="Reg charity number", number_prefix="NI", active=("differs", "Status", "Removed"),
    address="Public address", dated=True,
    columns={
        "name": "Charity name", "date_registered": "Date registered", "web": "Website", "company_number": "Company number",
        "activities": "what your organisation does", "objects": "charitable purposes", "income": "Total income",
        "spending": "Total spending", "fye": "Date for financial year ending",
    },
    lookups=(Lookup("activities", "regno"),),
)
REGISTERS = {r.source: r for r in (CCEW, OSCR, CCNI)}
# --- end of fixed values ---------------------------------------------------------


def _raw(name: str) -> Column:
    return F.col(f"`{name}`")


def unified(
    register: Register, raw: DataFrame, others: Mapping[str, DataFrame] | None = None, as_of: Column | None = None
) -> DataFrame:
    """A raw register in the unified columns.

    ``others`` holds the tables that the register looks things up in, by name; without one its columns are
    missing. Lookups take the smallest text that is there, so repeated numbers neither repeat records nor
    hide a text. ``as_of`` dates registers that carry no date (default: today).
    """
    others = others or {}
    rows = raw if register.main_entity is None else registry.filter_main_entity(raw, register.main_entity)
    wanted = set(register.columns.values())
    for look in register.lookups:
        if look.table not in others:
            continue
        side = others[look.table]
        if look.main_entity:
            side = registry.filter_main_entity(side, look.main_entity)
        if look.where:
            side = side.where(_raw(look.where))
        new = [c for c in side.columns if c in wanted and c not in raw.columns]
        side = side.select(_raw(look.key).alias(register.number), *[_raw(c) for c in new])
        rows = joins.left_lookup(rows, side, register.number, new)
        for name, value in look.default.items():
            if name in new:
                rows = rows.withColumn(name, F.coalesce(_raw(name), F.lit(value)))
    number = _raw(register.number).cast("string")
    rule, col, status = register.active
    mapping: dict[str, str | Column] = {name: _raw(c) for name, c in register.columns.items() if c in rows.columns}
    mapping |= {
        "org_id": F.concat(F.lit(register.id_prefix), number),
        "reg_number": F.concat(F.lit(register.number_prefix), number),
        "active": registry.active_flag(rule, _raw(col), status),
    }
    if register.address:
        mapping["postcode"] = postcode_from_address(_raw(register.address))
    if register.dated:
        mapping["last_updated"] = F.current_date() if as_of is None else as_of
    return registry.conform_registry(rows, mapping, {"source": register.source})

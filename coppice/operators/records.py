"""Roles of columns, and valid and ignored rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.text import null_if_blank, parse_date, trimmed

ROW = "row_index"
DIMENSIONS = ("assignment_group", "service", "category", "configuration_item")
RECORD_COLUMNS = (ROW, "incident_number", "analysis_text", *DIMENSIONS, "parsed_date")

#: Normalised headers that suggest a role; a priority column is recognised and not used.
HEADER_ROLES = {
    "incident_number": ("incnumber", "incidentnumber", "number"),
    "short_description": ("incshortdescription", "shortdescription", "summary"),
    "category": ("category",),
    None: ("priority",),
    "assignment_group": ("assignmentgroup", "assignedgroup"),
    "service": ("service", "businessservice"),
    "configuration_item": ("configurationitem", "ci", "cmdbci"),
    "date": ("created", "createddate", "opened", "openedat", "date"),
}


class MappingError(ValueError):
    """A mapping that doesn't fit its table."""


@dataclass(frozen=True)
class Mapping:
    """Roles to column positions."""

    incident_number: int | None = None
    short_description: int | None = None
    additional_text: tuple[int, ...] = field(default=())
    assignment_group: int | None = None
    service: int | None = None
    category: int | None = None
    configuration_item: int | None = None
    date: int | None = None

    @property
    def required(self) -> tuple[int | None, int | None]:
        return self.incident_number, self.short_description

    @property
    def ready(self) -> bool:
        return None not in self.required

    @property
    def required_status(self) -> str:
        return f"{sum(x is not None for x in self.required)} of 2"

    @property
    def filter_count(self) -> int:
        return sum(getattr(self, role) is not None for role in (*DIMENSIONS, "date"))

    @property
    def mapped_count(self) -> int:
        return self.filter_count + len(self.additional_text) + sum(x is not None for x in self.required)

    def with_additional(self, *columns: int) -> Mapping:
        """Additional text columns, sorted and without repeats."""
        return replace(self, additional_text=tuple(sorted({*self.additional_text, *columns})))

    def without_additional(self, column: int) -> Mapping:
        return replace(self, additional_text=tuple(c for c in self.additional_text if c != column))

    def to_dict(self) -> dict:
        return {**self.__dict__, "additional_text": list(self.additional_text)}

    @classmethod
    def from_dict(cls, values: dict) -> Mapping:
        known = {k: v for k, v in values.items() if k in cls.__dataclass_fields__}
        return cls(**{**known, "additional_text": tuple(known.get("additional_text") or ())})


def normalize_header(header: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "", header).lower()


def suggest_mapping(headers: Sequence[str]) -> Mapping:
    """Roles by header name; of several headers for one role the last wins."""
    role_of = {name: role for role, names in HEADER_ROLES.items() for name in names}
    found = {role: i for i, h in enumerate(headers) if (role := role_of.get(normalize_header(h)))}
    return Mapping(**found)


def validate_mapping(mapping: Mapping, headers: Sequence[str]) -> None:
    """Raise for a missing required role, then for the first position outside the table."""
    if mapping.incident_number is None:
        raise MappingError("incident number column is required")
    if mapping.short_description is None:
        raise MappingError("short description column is required")
    order = [*mapping.required, *mapping.additional_text]
    order += [getattr(mapping, role) for role in (*DIMENSIONS, "date")]
    for column in order:
        if column is not None and not 0 <= column < len(headers):
            raise MappingError(f"column index {column} is outside the source header range")


def _cell(columns: Sequence[str], index: int | None) -> Column:
    return F.lit("") if index is None else F.coalesce(F.col(f"`{columns[index]}`").cast("string"), F.lit(""))


def judged_rows(df: DataFrame, mapping: Mapping, columns: Sequence[str], *more: Column) -> DataFrame:
    """All rows with their record columns, the two reasons to ignore them, and further columns."""
    number, description = (trimmed(_cell(columns, i)) for i in mapping.required)
    extras = [null_if_blank(_cell(columns, i)) for i in mapping.additional_text]
    dimensions = [null_if_blank(_cell(columns, getattr(mapping, d))).alias(d) for d in DIMENSIONS]
    return df.select(
        F.col(ROW).cast("long").alias(ROW),
        number.alias("incident_number"),
        F.concat_ws(" ", description, *extras).alias("analysis_text"),
        *dimensions,
        parse_date(trimmed(_cell(columns, mapping.date))).alias("parsed_date"),
        (number == "").alias("missing_incident_number"),
        (description == "").alias("missing_short_description"),
        *more,
    )


def ignored_row() -> Column:
    return reduce(Column.__or__, (F.col("missing_incident_number"), F.col("missing_short_description")))


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records and ignored rows of ``judged_rows``."""
    bad = ignored_row()
    return judged.where(~bad).select(*RECORD_COLUMNS), judged.where(bad).select(ROW, "missing_incident_number", "missing_short_description")


def build_records(df: DataFrame, mapping: Mapping, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid records and ignored rows of a table with ``row_index``; ``columns`` are its cells in order.

    Two views of the table: where both are used, save ``judged_rows`` and split it, so that the table is read once.
    """
    columns = list(columns or [c for c in df.columns if c != ROW])
    validate_mapping(mapping, columns)
    return split_judged(judged_rows(df, mapping, columns))

"""The closed algebra of questions to a table: filters joined by AND, and one operation."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

#: Groups a ranking shows, and the most one may ask for.
RANKED, MOST_GROUPS = 5, 50

#: Comparisons, by the type of column they need.
TEXT = {"equals", "contains", "in"}
NUMERIC = {"greater_than", "less_than", "between"}
DATE = {"weekday", "month", "year", "date_range"}
#: Operations that need a numeric column, and all.
AGGREGATES = {"sum", "mean", "median", "min", "max"}
OPERATIONS = AGGREGATES | {
    "count", "distinct", "group_sum", "largest_group", "least_group", "top_groups", "groups_beyond", "count_per_group", "largest_row", "filter", "sort", "row_at",
}


@dataclass(frozen=True)
class Filter:
    """column compared with values: one value for most comparisons, two for between and date_range."""

    column: str
    comparison: str
    values: tuple[str | float | int | date, ...]


@dataclass(frozen=True)
class Operation:
    kind: str
    column: str | None = None
    group_by: str | None = None
    filters: tuple[Filter, ...] = ()
    n: int = RANKED
    threshold: float = 0.0
    above: bool = True
    descending: bool = False
    index: int = 0


@dataclass(frozen=True)
class ColumnInfo:
    """What inference says of a column: type numeric, date or categorical, and remarks."""

    name: str
    type: str
    has_formulas: bool = False
    year_like: bool = False
    unit: str | None = None
    unparsed: int = 0
    ambiguous_date: bool = False


@dataclass(frozen=True)
class Sheet:
    name: str
    columns: tuple[ColumnInfo, ...] = field(default_factory=tuple)


class Refusal(Exception):
    """A question that can't be answered exactly: reason is a code, details what it is about."""

    def __init__(self, reason: str, details: str = ""):
        super().__init__(f"{reason}: {details}")
        self.reason, self.details = reason, details


# Reasons for refusals.
REASONS = [
    "unknown_column", "ambiguous_column", "unknown_sheet", "ambiguous_sheet", "not_numeric", "not_a_date", "formula_column", "ambiguous_dates", "empty_sheet", "index_out_of_range", "unsupported_operation", "unsupported_group_aggregate",
]

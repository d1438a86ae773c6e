"""Plans as JSON in a closed vocabulary, validated strictly before they become operations."""

from __future__ import annotations

import json
from datetime import date

from lectern.plans.ast import Filter, Operation, Refusal, Sheet
from lectern.plans.compile import resolve_column

# The keys of a plan and of its filters, and comparison names.
KEYS = {"sheet", "filters", "group_by", "aggregate", "sort", "limit", "unsupported"}
FILTER_KEYS = {"column", "op", "value"}
COMPARISONS = {"eq": "equals", "in": "in", "contains": "contains", "gt": "greater_than", "lt": "less_than", "between": "between", "weekday": "weekday", "month": "month", "year": "year", "date_range": "date_range"}


def first_object(reply: str) -> dict | None:
    """The JSON object between the first brace of a reply and the last, or None."""
    a, b = reply.find("{"), reply.rfind("}")
    if a < 0 or b < a:
        return None
    try:
        found = json.loads(reply[a : b + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _filter(raw: object) -> Filter:
    if not isinstance(raw, dict) or set(raw) - FILTER_KEYS or raw.get("op") not in COMPARISONS or not raw.get("column"):
        raise Refusal("unsupported_operation", "filter")
    value = raw.get("value")
    values = value if isinstance(value, list) else [value]
    if not values or any(v is None or isinstance(v, (dict, list)) for v in values):
        raise Refusal("unsupported_operation", "value")
    kind = COMPARISONS[raw["op"]]
    if kind in ("between", "date_range") and len(values) != 2:
        raise Refusal("unsupported_operation", raw["op"])
    if kind == "date_range":
        try:
            values = sorted(date.fromisoformat(str(v)) for v in values)
        except ValueError as e:
            raise Refusal("not_a_date", str(values)) from e
    if kind in ("greater_than", "less_than", "between", "weekday", "month", "year"):
        try:
            values = [float(v) for v in values]
        except ValueError as e:
            raise Refusal("not_numeric", str(values)) from e
    if kind == "between":
        values = sorted(values)
    if kind in ("weekday", "month", "year"):
        values = [int(v) for v in values]
    return Filter(raw["column"], kind, tuple(values))


def build(plan: dict, sheet: Sheet) -> Operation:
    """The operation a plan asks for. Unknown keys, and per-group aggregates other than sum and count, are refused."""
    if set(plan) - KEYS:
        raise Refusal("unsupported_operation", ", ".join(sorted(set(plan) - KEYS)))
    if plan.get("unsupported"):
        raise Refusal("unsupported_operation", str(plan["unsupported"]))
    filters = tuple(_filter(f) for f in plan.get("filters") or [])
    for f in filters:
        resolve_column(sheet, f.column)
    aggregate, group, sort, limit = plan.get("aggregate") or {}, plan.get("group_by"), plan.get("sort") or {}, plan.get("limit")
    kind, column = aggregate.get("op"), aggregate.get("column")
    if group:
        resolve_column(sheet, group)
        if kind == "count":
            return Operation("count_per_group", group_by=group, filters=filters)
        if kind != "sum":
            raise Refusal("unsupported_group_aggregate", str(kind))
        if limit:
            return Operation("least_group" if sort.get("direction") == "asc" else "top_groups", column, group, filters, n=int(limit))
        return Operation("group_sum", column, group, filters)
    if kind:
        return Operation(kind, column, filters=filters)
    if sort:
        return Operation("sort", sort.get("column"), filters=filters, descending=sort.get("direction") == "desc")
    return Operation("filter", filters=filters)


def parse(reply: str, sheet: Sheet) -> Operation:
    plan = first_object(reply)
    if plan is None:
        raise Refusal("unsupported_operation", "no plan")
    return build(plan, sheet)

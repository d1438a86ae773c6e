"""Typed schemas for untidy sheets: header detection, number and date columns, units. Full passes, no samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import ambiguous_value, number_shape, parse_date, settles_day_first
from lectern.plans.ast import ColumnInfo, Sheet

#: Share of non-empty cells that must be numbers, and rows the header is sought in.
NUMERIC_SHARE, HEAD = 0.95, 20


def header_row(head: list[list[str | None]]) -> int | None:
    """The row among the first ones that reads like a header: textual, at least two cells filled, scored by how
    full and how distinct it is and how much typed data stands below; the first best one wins."""
    import re

    def typed(x: str | None) -> bool:
        return bool(x and re.search(r"\d", x) and re.fullmatch(r"[\d\s.,'’/:%€$()+-]*(?:CHF|Fr\.)?[\d\s.,'’/:%€$()+-]*", x.strip()))

    width = max((len(r) for r in head), default=0)
    best, found = 0.0, None
    for i, row in enumerate(head):
        filled = [c.strip() for c in row if c and c.strip()]
        if len(filled) < 2 or any(typed(c) for c in filled):
            continue
        below = [r[j] for r in head[i + 1 :] for j in range(len(row)) if j < len(r) and row[j] and r[j] and r[j].strip()]
        score = 0.4 * len(filled) / width + 0.3 * len(set(filled)) / len(filled) + 0.3 * (sum(map(typed, below)) / len(below) if below else 0)
        if score > best:
            best, found = score, i
    return found


def column_names(header: list[str | None] | None, width: int) -> list[str]:
    """Names from a header row; empty ones are column_N, repeated ones get a number."""
    names, seen = [], {}
    for i in range(width):
        name = (header[i] or "").strip() if header and i < len(header) else ""
        name = name or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


@dataclass(frozen=True)
class Reading:
    """How a text column is read: its description, and for numbers whether a lone separator groups digits."""

    info: ColumnInfo
    groups_digits: bool = False


def inventory(df: DataFrame, columns: list[str] | None = None, locale: str = "fr", formulas: frozenset[str] = frozenset()) -> list[Reading]:
    """Readings of text columns, from one aggregation over all rows.

    A column is numeric when nearly all its filled cells write numbers; whether an ambiguous separator groups
    or divides is settled by its other cells (decimals of another length, or the other separator), by there
    being several such cells, else by the locale. It is a date when all filled cells write one and one shows
    the order of day and month. The aggregate is one row however many rows there are.
    """
    columns = columns or df.columns
    # one row a cell, so that the code that reads a cell exists once however many columns there are; generators of one
    # row keep its parts from being computed anew in every aggregate
    cells = df.select(F.posexplode(F.array(*[F.trim(F.col(f"`{name}`").cast("string")) for name in columns])).alias("i", "cell")).where("cell <> ''")
    read = cells.select("i", "cell", F.inline(F.array(F.struct(number_shape(F.col("cell")).alias("shape"), parse_date(F.col("cell")).alias("dated"), F.regexp_extract("cell", r"([.,])(?:\d{1,2}|\d{4,})\D*$", 1).alias("decimal")))))
    shape, dated, cell = F.col("shape"), F.col("dated"), F.col("cell")
    unit = F.coalesce(shape["unit"], F.lit(""))
    per = read.groupBy("i").agg(
        F.count("*").alias("filled"),
        F.count_if(shape["kind"] != "invalid").alias("numbers"),
        F.count_if(shape["kind"] == "ambiguous").alias("doubtful"),
        F.count_if((shape["kind"] == "ambiguous") & (shape["separator"] == ",")).alias("commas"),
        F.count_if(F.col("decimal") == ",").alias("decimal_commas"),
        F.count_if(F.col("decimal") == ".").alias("decimal_points"),
        F.count_if(cell.rlike(r"\d[.,]\d{3}[.,]\d{3}")).alias("grouped"),
        F.count_if(dated.isNotNull()).alias("dates"),
        F.count_if(dated.isNotNull() & settles_day_first(cell)).alias("settled"),
        F.count_if((shape["value"] % 1 == 0) & shape["value"].between(1900, 2100)).alias("years"),
        F.min(unit).alias("unit_lo"),
        F.max(unit).alias("unit_hi"),
    )
    seen = {r["i"]: r.asDict() for r in per.collect()}  # one row a column
    out = []
    for i, name in enumerate(columns):
        own = seen.get(i, {})
        get = lambda what, own=own: own.get(what) or 0
        filled, numbers, doubtful = get("filled"), get("numbers"), get("doubtful")
        groups, conflict = False, False
        if doubtful:
            comma_decimal, point_decimal, grouped = get("decimal_commas"), get("decimal_points"), get("grouped")
            only_commas = get("commas") == doubtful
            as_decimal = comma_decimal if only_commas else point_decimal
            as_group = grouped + (point_decimal if only_commas else comma_decimal)
            conflict = bool(as_decimal and as_group) or 0 < get("commas") < doubtful
            groups = bool(as_group) or (not as_decimal and (doubtful >= 2 or locale != "fr" and only_commas))
        unit = own["unit_lo"] if own.get("unit_lo") and own["unit_lo"] == own["unit_hi"] else None
        formula = name in formulas
        if filled and get("dates") == filled:
            settled = get("settled") > 0
            out.append(Reading(ColumnInfo(name, "date" if settled else "categorical", formula, ambiguous_date=not settled)))
        elif filled and numbers and not conflict and numbers / filled >= NUMERIC_SHARE:
            out.append(Reading(ColumnInfo(name, "numeric", formula, get("years") == filled, unit, filled - numbers), groups))
        else:
            out.append(Reading(ColumnInfo(name, "categorical", formula)))
    return out


def typed(df: DataFrame, readings: list[Reading]) -> tuple[DataFrame, Sheet]:
    """df with columns read as their readings say (text is kept beside as <name>_raw), and the sheet."""
    out = df
    for r in readings:
        c = F.col(f"`{r.info.name}`").cast("string")
        if r.info.type == "numeric":
            shape = number_shape(c)
            value = F.when(shape["kind"] == "ambiguous", ambiguous_value(shape, F.lit(r.groups_digits))).otherwise(shape["value"])
        elif r.info.type == "date":
            value = parse_date(c)
        else:
            continue
        out = out.withColumn(f"{r.info.name}_raw", c).withColumn(r.info.name, value)
    return out, Sheet("sheet", tuple(r.info for r in readings))

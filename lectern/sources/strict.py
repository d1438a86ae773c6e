"""Loading delimited lines strictly and telling why the others fail.

Only lines that conform are loaded, typed. The offsets of all lines minus those loaded leave the remainder,
which is then diagnosed. Everything stays in JVM expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a run of quoted text while the shape of a line is checked; not a character of text.
MARK = "\u0001"

#: The words a title line of an export opens with.
TITLES = ["export", "exporté", "extrait", "liste", "état", "relevé", "rapport", "rendez-vous", "patients", "cabinet"]


@dataclass(frozen=True)
class Layout:
    """Columns of the files, in order, with the types that must hold: amount or birth_date; others are text."""

    columns: tuple[str, ...]
    headers: tuple[str, ...]
    kinds: tuple[tuple[str, str], ...] = ()
    delimiter: str = ";"


RENDEZ_VOUS = Layout(
    ("date_rdv", "patient", "medecin", "motif", "montant", "caisse"),
    ("Date", "Patient", "Médecin", "Motif", "Montant", "Caisse"),
    (("montant", "amount"),),
)
PATIENTS = Layout(
    ("nom", "prenom", "date_de_naissance", "no_avs", "caisse_maladie", "commune", "npa"),
    ("Nom", "Prénom", "Date de naissance", "N° AVS", "Caisse maladie", "Commune", "NPA"),
    (("date_de_naissance", "birth_date"),),
)

# An amount: French or Swiss grouping, decimals after comma or point or the Swiss dash, a currency on either side.
_DIGITS = r"(?:\d{1,3}(?:[   ]\d{3})+|\d{1,3}(?:['’]\d{3})+|\d+)(?:[.,]\d{1,2}|[.,][-–—])?"
AMOUNT = rf"^(?:(?:CHF|€)[   ]?)?[+-]?{_DIGITS}(?:[   ]?(?:CHF|€))?$"
_DAY_FIRST = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})$"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})$"


def marked(line: Column) -> Column:
    """The line with each quoted run replaced by a mark; a doubled quote leaves two marks side by side."""
    return F.regexp_replace(F.translate(line, MARK, " "), r'"[^"]*"', MARK)


def cell_count(line: Column, delimiter: str = ";") -> Column:
    """Cells of a line, counting only delimiters outside quotes."""
    return F.length(marked(line)) - F.length(F.replace(marked(line), F.lit(delimiter), F.lit(""))) + 1


def well_formed(line: Column, width: int, delimiter: str = ";") -> Column:
    """Whether the line is width cells, each without quotes or wholly quoted with inner quotes doubled."""
    cell = rf"(?:{MARK}+|[^\"{delimiter}{MARK}]*)"
    return F.coalesce(marked(line).rlike(rf"^{cell}(?:{delimiter}{cell}){{{width - 1}}}\z"), F.lit(False))


def amount(cell: Column) -> Column:
    """The number a cell writes in French or Swiss style, null where it writes none."""
    bare = F.regexp_replace(F.trim(cell), r"CHF|€|[   '’]|[.,][-–—]", "")
    return F.when(F.trim(cell).rlike(AMOUNT), F.replace(bare, F.lit(","), F.lit(".")).try_cast("decimal(18,2)"))


def full_date(cell: Column) -> Column:
    """The calendar date of a cell in day.month.year or ISO order with a four-digit year, else null."""
    c = F.trim(cell)
    day_first = F.concat_ws("-", F.regexp_extract(c, _DAY_FIRST, 4), F.regexp_extract(c, _DAY_FIRST, 3), F.regexp_extract(c, _DAY_FIRST, 1))
    return F.when(c.rlike(_DAY_FIRST), F.try_to_date(day_first, "yyyy-M-d")).when(c.rlike(_ISO), F.try_to_date(c, "yyyy-MM-dd"))


def blank(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s+", "")) == 0, F.lit(True))


def parsed(lines: DataFrame, layout: Layout, line: str = "raw_line") -> DataFrame:
    """lines with the struct cells of what each well-formed line holds; null cells elsewhere."""
    schema = ", ".join(f"{c} string" for c in layout.columns)
    fits = well_formed(F.col(line), len(layout.columns), layout.delimiter)
    options = {"sep": layout.delimiter, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}
    return lines.withColumn("cells", F.when(fits, F.from_csv(F.col(line), schema, options)))


def furniture(layout: Layout, line: str = "raw_line") -> Column:
    """Whether a line is a blank line, a header or a title rather than a record."""
    text = F.coalesce(F.regexp_replace(F.col(line), "^﻿", ""), F.lit(""))
    bare = F.regexp_replace(F.replace(text, F.lit(layout.delimiter), F.lit("")), r'(?U)[\s"]+', "")
    names = F.array(*[F.lit(h.lower()) for h in layout.headers])
    seen = F.transform(F.split(F.lower(F.replace(text, F.lit('"'), F.lit(""))), layout.delimiter), F.trim)
    header = F.size(F.array_intersect(seen, names)) * 2 > len(layout.headers)
    title = F.lower(text).rlike(rf"(?U)^\"?(?:{'|'.join(TITLES)})\b[^{layout.delimiter}\t|]*{layout.delimiter}*\s*\z")
    return (bare == "") | header | title


def faults(layout: Layout, loaded_at: str = "loaded_at") -> dict[str, Column]:
    """For each typed column of parsed rows, whether its cell is neither blank nor of its type."""
    out = {}
    for column, kind in layout.kinds:
        cell = F.col("cells")[column]
        if kind == "amount":
            good = amount(cell).isNotNull()
        else:
            day = full_date(cell)
            latest = F.coalesce(F.col(loaded_at).cast("date"), F.current_date())
            good = F.coalesce(day.between(F.lit("1900-01-01").cast("date"), latest), F.lit(False))
        out[column] = ~blank(cell) & ~good
    return out


def load(lines: DataFrame, layout: Layout, key: str = "row_id", line: str = "raw_line", loaded_at: str = "loaded_at") -> DataFrame:
    """The records that conform, typed: key and the layout's columns.

    Blank cells are null. Titles, headers and blank lines are no records. Null lines count as blank. Columns of
    lines beyond key, line and loaded_at are dropped, so names cannot clash; repeated records all load.
    """
    rows = parsed(lines.select(key, line, loaded_at), layout, line).where(F.col("cells").isNotNull() & ~furniture(layout, line))
    for bad in faults(layout, loaded_at).values():
        rows = rows.where(~bad)
    kinds = dict(layout.kinds)
    typed = {"amount": amount, "birth_date": full_date}
    cell = lambda c: typed[kinds[c]](F.col("cells")[c]) if c in kinds else F.when(~blank(F.col("cells")[c]), F.trim(F.col("cells")[c]))
    return rows.select(key, *[cell(c).alias(c) for c in layout.columns])


def rejected(lines: DataFrame, layout: Layout, key: str = "row_id", line: str = "raw_line", loaded_at: str = "loaded_at") -> DataFrame:
    """The lines that are records but don't load, as key, line, reason and n_cells: all offsets less those
    loaded. key must be unique. An empty table gives no rows.

    Reasons: unbalanced_quote, broken_quoting, other_delimiter, too_few_columns, too_many_columns, then
    invalid_<column>.
    """
    width = len(layout.columns)
    rest = lines.select(key, line, loaded_at).join(load(lines, layout, key, line, loaded_at).select(key), key, "left_anti")
    rest = parsed(rest.where(~furniture(layout, line)), layout, line)
    n = cell_count(F.col(line), layout.delimiter)
    quoted = marked(F.col(line))
    reason = (
        F.when(quoted.contains('"'), "unbalanced_quote")
        .when((n == 1) & (F.size(F.split(quoted, r"[\t|,]")) >= width), "other_delimiter")
        .when(n < width, "too_few_columns")
        .when(n > width, "too_many_columns")
        .when(F.col("cells").isNull(), "broken_quoting")
    )
    for column, bad in faults(layout, loaded_at).items():
        reason = reason.when(bad, f"invalid_{column}")
    return rest.select(key, line, reason.otherwise("unknown").alias("reason"), n.alias("n_cells"))

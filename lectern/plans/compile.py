"""From operations to DataFrames. Guards run on metadata, before any row is read.

Results carry their provenance: row_count, the rows that matched, and unparsed, those whose amount no number
could be read from. That nothing matched is an answer only to a count; elsewhere the result's reason is
empty_sheet and its value null, decided in the same aggregation, without a second pass.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import fold
from lectern.operators import quantiles
from lectern.plans.ast import AGGREGATES, DATE, MOST_GROUPS, NUMERIC, OPERATIONS, RANKED, TEXT, ColumnInfo, Filter, Operation, Refusal, Sheet


def describe(df: DataFrame, name: str = "sheet") -> Sheet:
    """The sheet a typed DataFrame is: numbers numeric, dates and timestamps date, all else categorical."""

    def kind(t: T.DataType) -> str:
        if isinstance(t, T.NumericType):
            return "numeric"
        return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical"

    return Sheet(name, tuple(ColumnInfo(f.name, kind(f.dataType)) for f in df.schema.fields))


def _plain(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def resolve_column(sheet: Sheet, name: str) -> ColumnInfo:
    """A column by its exact name, else by its folded one; several folded matches are refused."""
    exact = [c for c in sheet.columns if c.name == name]
    if len(exact) == 1:
        return exact[0]
    alike = [c for c in sheet.columns if _plain(c.name) == _plain(name)]
    if len(alike) > 1:
        raise Refusal("ambiguous_column", name)
    if not alike:
        raise Refusal("unknown_column", name)
    return alike[0]


def resolve_sheet(sheets: list[Sheet], name: str | None, allowed: list[str] | None = None) -> Sheet:
    """A reachable sheet by name; without one, the only reachable sheet. Names outside the scope don't exist."""
    within = [s for s in sheets if allowed is None or s.name in allowed]
    found = within if name is None else [s for s in within if s.name == name] or [s for s in within if _plain(s.name) == _plain(name)]
    if not found:
        raise Refusal("unknown_sheet", name or "")
    if len(found) > 1:
        raise Refusal("ambiguous_sheet", name or "")
    return found[0]


def value_column(sheet: Sheet, name: str | None) -> ColumnInfo:
    c = resolve_column(sheet, name or "")
    if c.has_formulas:
        raise Refusal("formula_column", c.name)
    return c


def numeric_column(sheet: Sheet, name: str | None) -> ColumnInfo:
    c = value_column(sheet, name)
    if c.type != "numeric":
        raise Refusal("not_numeric", c.name)
    return c


def predicate(sheet: Sheet, f: Filter) -> Column:
    """A filter as a condition that is never null."""
    c = value_column(sheet, f.column)
    if f.comparison in NUMERIC and c.type != "numeric":
        raise Refusal("not_numeric", c.name)
    if f.comparison in DATE and c.type != "date":
        raise Refusal("ambiguous_dates" if c.ambiguous_date else "not_a_date", c.name)
    col, v = F.col(f"`{c.name}`"), f.values
    if f.comparison in TEXT:
        text, wanted = fold(col.cast("string")), [_plain(str(x)) for x in v]
        test = text.contains(wanted[0]) if f.comparison == "contains" else text.isin(wanted)
    elif f.comparison == "greater_than":
        test = col > v[0]
    elif f.comparison == "less_than":
        test = col < v[0]
    elif f.comparison == "between":
        test = col.between(min(v), max(v))
    elif f.comparison == "weekday":
        test = F.weekday(col) + 1 == v[0]
    elif f.comparison == "month":
        test = F.month(col) == v[0]
    elif f.comparison == "year":
        # as a range, so that it reaches the scan
        low, high = f"{int(v[0]):04d}-01-01", f"{int(v[0]) + 1:04d}-01-01"
        test = (col >= F.lit(low).cast("date")) & (col < F.lit(high).cast("date"))
    elif f.comparison == "date_range":
        test = (col >= F.lit(str(v[0])).cast("date")) & (col < F.date_add(F.lit(str(v[1])).cast("date"), 1))
    else:
        raise Refusal("unsupported_operation", f.comparison)
    return F.coalesce(test, F.lit(False))


def matching(df: DataFrame, sheet: Sheet, filters: tuple[Filter, ...]) -> DataFrame:
    """Rows that meet all filters; all rows without any."""
    tests = [predicate(sheet, f) for f in filters]
    return df.where(reduce(and_, tests)) if tests else df


def _refused(count: Column) -> Column:
    return F.when(count == 0, "empty_sheet")


def execute(df: DataFrame, sheet: Sheet, op: Operation, row_index: str | None = None) -> DataFrame:
    """The answer of an operation. row_index names the column of source order, unique integers, which largest_row, sort,
    filter and row_at need: without one they are refused, as rows of a DataFrame have no order of their own. Ties fall to
    the lesser index, and descending sorts reverse ties too. row_at counts positions in that order from 0."""
    if op.kind not in OPERATIONS:
        raise Refusal("unsupported_operation", op.kind)
    if row_index is None and op.kind in {"largest_row", "sort", "filter", "row_at"}:
        raise Refusal("no_row_order", op.kind)
    order = F.col(f"`{row_index}`") if row_index else F.lit(0)
    if op.kind == "count":
        return matching(df, sheet, op.filters).agg(F.count("*").alias("value"))
    if op.kind in AGGREGATES:
        c = F.col(f"`{numeric_column(sheet, op.column).name}`")
        if op.kind == "median":
            kept = matching(df, sheet, op.filters)
            value = F.lit(quantiles.median(kept, numeric_column(sheet, op.column).name)).cast("double")
        else:
            value = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[op.kind](c)
        return matching(df, sheet, op.filters).agg(value.cast("double").alias("value"), F.count("*").alias("row_count"), F.count_if(c.isNull()).alias("unparsed"), F.lit(numeric_column(sheet, op.column).unit).cast("string").alias("unit"), _refused(F.count("*")).alias("reason"))
    if op.kind == "distinct":
        c = F.col(f"`{value_column(sheet, op.column).name}`").cast("string")
        return matching(df, sheet, op.filters).where(F.trim(c) != "").select(c.alias("value")).distinct().orderBy("value")
    if op.kind == "count_per_group":
        key = F.col(f"`{value_column(sheet, op.group_by).name}`")
        kept = matching(df, sheet, op.filters).where(F.trim(key.cast("string")) != "")
        return kept.groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")
    if op.kind in {"group_sum", "largest_group", "least_group", "top_groups", "groups_beyond"}:
        key, c = F.col(f"`{value_column(sheet, op.group_by).name}`"), F.col(f"`{numeric_column(sheet, op.column).name}`")
        groups = matching(df, sheet, op.filters).where(c.isNotNull() & (F.trim(key.cast("string")) != "")).groupBy(key.alias("key")).agg(F.sum(c).cast("double").alias("total"))
        if op.kind == "group_sum":
            return groups.orderBy("key")
        if op.kind == "groups_beyond":
            beyond = F.col("total") > op.threshold if op.above else F.col("total") < op.threshold
            return groups.where(beyond).orderBy(F.desc("total") if op.above else F.asc("total"), "key")
        n = min(op.n, MOST_GROUPS) if op.kind == "top_groups" else RANKED
        said = [F.lit(op.n).alias("requested"), F.lit(op.n > MOST_GROUPS).alias("capped")] if op.kind == "top_groups" else []
        ranked = groups.orderBy(F.asc("total") if op.kind == "least_group" else F.desc("total"), "key").limit(n)
        # how many groups there are is one row, made from the same sums
        return ranked.join(F.broadcast(groups.agg(F.count("*").alias("group_count")))).select("*", *said).orderBy(F.asc("total") if op.kind == "least_group" else F.desc("total"), "key")
    if op.kind == "largest_row":
        c = F.col(f"`{numeric_column(sheet, op.column).name}`")
        rows = matching(df, sheet, op.filters).where(c.isNotNull())
        return rows.agg(F.max_by(F.struct("*"), F.struct(c, -order)).alias("row")).where("row is not null").select("row.*")
    if op.kind == "filter":
        return matching(df, sheet, op.filters).orderBy(order)
    if op.kind == "row_at":
        at = quantiles.value_at(df, str(row_index), op.index)
        if at is None:
            raise Refusal("row_out_of_range", str(op.index))
        return df.where(order == F.lit(int(at)))
    c = F.col(f"`{value_column(sheet, op.column).name}`")
    kept = matching(df, sheet, op.filters)
    return kept.orderBy(c.desc_nulls_last(), order.desc()) if op.descending else kept.orderBy(c.asc_nulls_first(), order)


def nearest_group(df: DataFrame, sheet: Sheet, op: Operation) -> DataFrame:
    """The group whose total is closest to a threshold, for when none lies beyond it."""
    groups = execute(df, sheet, Operation("group_sum", op.column, op.group_by, op.filters))
    return groups.agg(F.min_by(F.struct("key", "total"), F.struct(F.abs(F.col("total") - op.threshold), "key")).alias("g")).select("g.*")


def close_values(df: DataFrame, column: str, word: str, most: int = 2, n: int = 5) -> DataFrame:
    """Real values near a word that none equals: folded prefixes first, then by edits, at most n."""
    values = df.select(F.col(column).cast("string").alias("value")).where(F.trim("value") != "").distinct()
    w, v = F.lit(_plain(word)), fold(F.col("value"))
    far = F.when(F.startswith(v, w), 0).otherwise(F.levenshtein(v, w) + 1)
    return values.withColumn("far", far).where(F.col("far") <= most + 1).orderBy("far", "value").limit(n)


def row_cells(df: DataFrame, row_index: str) -> DataFrame:
    """Every row as its cells: (row, column, text), columns in the sheet's order by place."""
    others = [c for c in df.columns if c != row_index]
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(others)])
    return df.select(F.col(f"`{row_index}`").alias("row"), F.explode(cells).alias("x")).select("row", "x.place", "x.column", "x.text")

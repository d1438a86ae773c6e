"""Queries of the tabular algebra over the star schema, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.numbers import number_shape
from lectern.operators.quantiles import percentile
from lectern.plans import query_plan
from lectern.plans.ast import Filter, Operation, Refusal
from lectern.plans.compile import close_values, describe, execute, nearest_group, row_cells
from lectern.plans.infer import inventory, typed
from lectern.plans.question import classify
from lectern.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; two are kept."""
    return df.withColumns({n: F.round(n, 2) for n in names or ("value",)})


def _op(name: str, of: str, op: Operation, sql: str, columns: tuple[str, ...] | None = None, rounded: tuple[str, ...] = (), index: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, of)
        out = execute(df, describe(df), op, index)
        out = _rounded(out, *rounded) if rounded else out
        return out.select(*columns) if columns else out

    run.__doc__ = f"{op.kind} over {of}."
    QUERIES[name], SQL[name] = run, sql


_L = "lineitem"
_op("t_count_filtered", _L, Operation("count", filters=(Filter("l_returnflag", "equals", ("r",)), Filter("l_quantity", "greater_than", (30.0,)))), "SELECT count(*) AS value FROM lineitem WHERE lower(l_returnflag) = 'r' AND l_quantity > 30")
for _k, _f in (("sum", "sum"), ("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    _op(
        f"t_{_k}",
        _L,
        Operation(_k, "l_extendedprice", filters=(Filter("l_linestatus", "in", ("F",)),)),
        f"SELECT round({_f}(l_extendedprice), 2) AS value, count(*) AS row_count, count(*) - count(l_extendedprice) AS unparsed, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS reason FROM lineitem WHERE l_linestatus = 'F'",
        rounded=("value",),
    )
_op(
    "t_refused_empty",
    _L,
    Operation("sum", "l_tax", filters=(Filter("l_quantity", "less_than", (-1.0,)),)),
    "SELECT CAST(NULL AS DOUBLE) AS value, 0 AS row_count, 0 AS unparsed, CAST(NULL AS VARCHAR) AS unit, 'empty_sheet' AS reason",
)
_op("t_distinct", "customer", Operation("distinct", "c_mktsegment"), "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE trim(c_mktsegment) <> ''")
_op("t_count_per_group", "orders", Operation("count_per_group", group_by="o_orderpriority"), "SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1")
_op("t_group_sum", _L, Operation("group_sum", "l_quantity", "l_returnflag", (Filter("l_discount", "between", (0.02, 0.06)),)), "SELECT l_returnflag AS key, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 GROUP BY 1", rounded=("total",))
_SUMS = "WITH g AS (SELECT o_custkey AS key, sum(o_totalprice) AS total FROM orders GROUP BY 1)"
_op("t_largest_group", "orders", Operation("largest_group", "o_totalprice", "o_custkey"), f"{_SUMS} SELECT key, round(total, 2) AS total, (SELECT count(*) FROM g) AS group_count FROM g ORDER BY g.total DESC, key LIMIT 5", rounded=("total",))
_op("t_least_group", "orders", Operation("least_group", "o_totalprice", "o_custkey"), f"{_SUMS} SELECT key, round(total, 2) AS total, (SELECT count(*) FROM g) AS group_count FROM g ORDER BY g.total, key LIMIT 5", rounded=("total",))
_op("t_top_groups", "orders", Operation("top_groups", "o_totalprice", "o_custkey", n=80), f"{_SUMS} SELECT key, round(total, 2) AS total, (SELECT count(*) FROM g) AS group_count, 80 AS requested, true AS capped FROM g ORDER BY g.total DESC, key LIMIT 50", rounded=("total",))
_op("t_groups_beyond", "orders", Operation("groups_beyond", "o_totalprice", "o_custkey", threshold=2_000_000.0), f"{_SUMS} SELECT key, round(total, 2) AS total FROM g WHERE g.total > 2000000", rounded=("total",))
_op("t_groups_below", "orders", Operation("groups_beyond", "o_totalprice", "o_custkey", threshold=100_000.0, above=False), f"{_SUMS} SELECT key, round(total, 2) AS total FROM g WHERE g.total < 100000", rounded=("total",))
_op("t_largest_row", "orders", Operation("largest_row", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", ("o_orderkey", "o_custkey", "o_totalprice"), index="o_orderkey")
_op("t_filter_rows", "supplier", Operation("filter", filters=(Filter("s_acctbal", "less_than", (0.0,)),)), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal < 0", index="s_suppkey")
_op("t_row_at", "part", Operation("row_at", index=17), "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1 OFFSET 17", ("p_partkey", "p_name"), index="p_partkey")
_D = "o_orderkey", "o_orderstatus"
_op("t_weekday", "orders", Operation("filter", filters=(Filter("o_orderdate", "weekday", (1,)), Filter("o_orderstatus", "equals", ("F",)))), "SELECT o_orderkey, o_orderstatus FROM orders WHERE isodow(o_orderdate) = 1 AND o_orderstatus = 'F'", _D, index="o_orderkey")
_op("t_month", "orders", Operation("filter", filters=(Filter("o_orderdate", "month", (2,)),)), "SELECT o_orderkey, o_orderstatus FROM orders WHERE month(o_orderdate) = 2", _D, index="o_orderkey")
_op("t_year", "orders", Operation("filter", filters=(Filter("o_orderdate", "year", (1995,)),)), "SELECT o_orderkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1995", _D, index="o_orderkey")
_op("t_date_range", "orders", Operation("filter", filters=(Filter("o_orderdate", "date_range", ("1996-03-01", "1996-03-31")),)), "SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'", _D, index="o_orderkey")
_op("t_contains", "part", Operation("filter", filters=(Filter("p_type", "contains", ("ECO",)),)), "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'eco')", ("p_partkey", "p_type"), index="p_partkey")
_op("t_in", "customer", Operation("count", filters=(Filter("c_mktsegment", "in", ("building", "MACHINERY")),)), "SELECT count(*) AS value FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")


@_add("t_sort_page", "SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC LIMIT 25 OFFSET 50)")
def t_sort_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of customers, richest first, ties reversed with the order."""
    df = table(spark, d, "customer")
    return execute(df, describe(df), Operation("sort", "c_acctbal", descending=True), "c_custkey").select("c_custkey", "c_acctbal").offset(50).limit(25)


@_add("t_nearest_group", f"{_SUMS} SELECT key, round(total, 2) AS total FROM g ORDER BY abs(g.total - 1000000), key LIMIT 1")
def t_nearest_group(spark: SparkSession, d: str) -> DataFrame:
    """The customer whose total is nearest to a million."""
    df = table(spark, d, "orders")
    return _rounded(nearest_group(df, describe(df), Operation("groups_beyond", "o_totalprice", "o_custkey", threshold=1_000_000.0)), "total")


@_add("t_close_values", "SELECT value FROM (SELECT value, CASE WHEN starts_with(lower(value), 'bilding') THEN 0 ELSE levenshtein(lower(value), 'bilding') + 1 END AS far FROM (SELECT DISTINCT c_mktsegment AS value FROM customer)) WHERE far <= 3 ORDER BY far, value LIMIT 5")
def t_close_values(spark: SparkSession, d: str) -> DataFrame:
    """Segments near a misspelt word."""
    return close_values(table(spark, d, "customer"), "c_mktsegment", "bilding").select("value")


@_add("t_plan_json", "SELECT l_shipmode AS key, total FROM (SELECT l_returnflag AS l_shipmode, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_linestatus = 'O' AND l_quantity BETWEEN 10 AND 20 GROUP BY 1)")
def t_plan_json(spark: SparkSession, d: str) -> DataFrame:
    """A plan in JSON, with prose around it, answered."""
    reply = """The plan: {"filters": [{"column": "l_linestatus", "op": "eq", "value": "o"}, {"column": "l_quantity", "op": "between", "value": [20, 10]}],
        "group_by": "l_returnflag", "aggregate": {"op": "sum", "column": "l_extendedprice"}}."""
    df = table(spark, d, "lineitem")
    sheet = describe(df)
    return _rounded(execute(df, sheet, query_plan.parse(reply, sheet)), "total")


@_add("t_question", "SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def t_question(spark: SparkSession, d: str) -> DataFrame:
    """A question in words, classified and answered."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    sheet = describe(df)
    route = classify("Quel est le total o_totalprice par o_orderpriority en 1996 ?", sheet)
    return _rounded(execute(df, sheet, route.operation), "total")


@_add("t_question_threshold", f"{_SUMS} SELECT key, round(total, 2) AS total FROM (SELECT o_orderstatus AS key, sum(o_totalprice) AS total FROM orders GROUP BY 1) WHERE total > 1000000")
def t_question_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A count over groups beyond a threshold, rewritten to the groups themselves."""
    df = table(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    sheet = describe(df)
    route = classify("How many o_orderstatus have an o_totalprice above 1000000?", sheet)
    return _rounded(execute(df, sheet, route.operation), "total")


_UNITS = r"(SFr\.|CHF|Fr\.|€|\$|%)"
_CORE = rf"regexp_replace(trim(regexp_replace(regexp_replace(trim({{c}}), '^{_UNITS}\s*', ''), '\s*{_UNITS}$', '')), '^[(+\-−]\s*|\)$', '', 'g')"
_GAPPED = r"regexp_replace({x}, '(\d)[  ''’](\d{{3}})(\D|$)', '\1\2\3', 'g')"


def _tight(c: str) -> str:
    """SQL of a cell without unit, sign and gaps between digits; gaps go from the last to the first."""
    x = _CORE.format(c=c)
    for _ in range(3):
        x = _GAPPED.format(x=x)
    return x


_PLAIN, _POINTED, _COMMAED = r"^\d+$|^\d+[.,](\d{1,2}|\d{4,})$|^(0|\d{4,})[.,]\d{3}$", r"^\d{1,3}(\.\d{3})+,\d+$|^\d{1,3}(\.\d{3}){2,}$", r"^\d{1,3}(,\d{3})+\.\d+$|^\d{1,3}(,\d{3}){2,}$"
_NUMBER = rf"{_PLAIN}|{_POINTED}|{_COMMAED}|^[1-9]\d{{0,2}}[.,]\d{{3}}$"
_VALUE = f"CASE WHEN regexp_matches(t, '{_PLAIN}') THEN TRY_CAST(replace(t, ',', '.') AS DOUBLE) WHEN regexp_matches(t, '{_POINTED}') THEN TRY_CAST(replace(replace(t, '.', ''), ',', '.') AS DOUBLE) WHEN regexp_matches(t, '{_COMMAED}') THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) END"


@_add("t_cells", rf"SELECT row_id, CASE WHEN {_VALUE} IS NOT NULL THEN 'resolved' WHEN regexp_matches(t, '^[1-9]\d{{0,2}}[.,]\d{{3}}$') THEN 'ambiguous' ELSE 'invalid' END AS kind, CASE WHEN regexp_matches(montant, '^\s*(-|−|\()') THEN -1 ELSE 1 END * {_VALUE} AS value FROM (SELECT row_id, montant, {_tight('montant')} AS t FROM rendez_vous_lilas WHERE trim(montant) <> '')")
def t_cells(spark: SparkSession, d: str) -> DataFrame:
    """What every filled cell of the amounts writes: a number, an ambiguous one, or none."""
    rows = table(spark, d, "rendez_vous_lilas").where("trim(montant) <> ''")
    return rows.select("row_id", number_shape(F.col("montant")).alias("x")).select("row_id", "x.kind", "x.value")


@_add(
    "t_inferred_sum",
    rf"WITH c AS (SELECT trim(montant) AS v, {_tight('montant')} AS t FROM rendez_vous_lilas WHERE trim(montant) <> ''), s AS (SELECT count(*) AS filled, count(*) FILTER (regexp_matches(t, '{_NUMBER}')) AS numbers, sum({_VALUE}) AS total FROM c) "
    "SELECT CASE WHEN numbers / filled >= 0.95 THEN round(total, 2) END AS value, filled, numbers, CASE WHEN numbers / filled < 0.95 THEN 'not_numeric' END AS reason FROM s",
)
def t_inferred_sum(spark: SparkSession, d: str) -> DataFrame:
    """The whole column of amounts as typed in: its sum where nearly all cells are numbers, else the refusal, with the counts."""
    rows = table(spark, d, "rendez_vous_lilas").select("montant")
    filled = F.trim("montant") != ""
    counts = rows.agg(F.count_if(filled).alias("filled"), F.count_if(filled & (number_shape(F.col("montant"))["kind"] != "invalid")).alias("numbers"))
    out, sheet = typed(rows, inventory(rows))
    try:
        answer = _rounded(execute(out, sheet, Operation("sum", "montant"))).select("value", "reason")
    except Refusal as r:
        answer = spark.range(1).select(F.lit(None).cast("double").alias("value"), F.lit(r.reason).alias("reason"))
    return answer.join(F.broadcast(counts))  # one row each


_TEXTS = ["nom", "prenom", "date_de_naissance", "no_avs", "caisse_maladie", "commune", "npa"]
_DATED = r"regexp_full_match(trim({c}), '\d{{4}}-\d\d-\d\d|\d\d?[/.-]\d\d?[/.-]\d{{4}}')"


@_add(
    "t_inferred_schema",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, CASE WHEN count(*) FILTER ({_DATED.format(c=c)}) = count(*) THEN 'date' WHEN count(*) FILTER (regexp_matches({_tight(c)}, '{_NUMBER}')) / count(*) >= 0.95 THEN 'numeric' ELSE 'categorical' END AS type FROM patients_ch WHERE trim({c}) <> ''"
        for c in _TEXTS
    ),
)
def t_inferred_schema(spark: SparkSession, d: str) -> DataFrame:
    """What inference says of all text columns of the patients' export, over all its lines."""
    return spark.createDataFrame([(r.info.name, r.info.type) for r in inventory(table(spark, d, "patients_ch").select(*_TEXTS))], "name string, type string")


@_add("t_percentiles", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p AS share, min(value) AS value FROM r, (VALUES (0.5), (0.95), (0.99)) AS t(p) WHERE k >= ceil(p * n) GROUP BY 1")
def t_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of a measure."""
    e = table(spark, d, "events")
    return spark.createDataFrame([(p, percentile(e, "value", p)) for p in (0.5, 0.95, 0.99)], "share double, value double")


@_add("t_pass_totals", "SELECT event_type AS block, (event_id % 7)::VARCHAR AS feature, count(*) AS total, count(*) FILTER (value > 50) AS passed FROM events GROUP BY GROUPING SETS ((event_type, event_id % 7), (event_type), ())")
def t_pass_totals(spark: SparkSession, d: str) -> DataFrame:
    """Passed and all cases by block and feature, by block, and in all."""
    e = table(spark, d, "events").select(F.col("event_type").alias("block"), (F.col("event_id") % 7).cast("string").alias("feature"), "value")
    return e.groupingSets([["block", "feature"], ["block"], []], "block", "feature").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("passed"))


@_add("t_structural", "SELECT column_name AS name, CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'categorical' END AS type FROM (DESCRIBE orders) AS t(column_name, data_type, a, b, c, e)")
def t_structural(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a sheet and their types."""
    sheet = describe(table(spark, d, "orders"))
    return spark.createDataFrame([(c.name, c.type) for c in sheet.columns], "name string, type string")


@_add("t_row_cells", " UNION ALL ".join(f"SELECT s_suppkey AS row, {i} AS place, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS text FROM supplier" for i, c in enumerate(("s_name", "s_nationkey"))))
def t_row_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows as cells of text."""
    return row_cells(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")

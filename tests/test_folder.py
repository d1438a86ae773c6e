"""Routes, set search, inventory, profiles and names in texts on small cases: nulls, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import extract, profiles, routing
from lectern.plans.ast import Operation, Refusal, Sheet
from lectern.plans.compile import describe, execute, row_cells

FILES = [
    (1, "documents", "a/lettre 2.pdf", "c1", "pdf", "analysed", "courrier", "Lettre LIL", "2024-03-01"),
    (2, "data", "b/Lettre 10.pdf", "c1", "pdf", "analysed", None, None, "2024"),
    (3, "documents", "a/élan.txt", None, "txt", "unreadable", "note", "Élan", None),
    (4, "documents", "c.eml", "c3", None, None, None, "", "2023-01"),
]


@pytest.fixture(scope="module")
def files(spark):
    schema = "profile_id bigint, domain string, relative_path string, content_id string, format string, state string, business_type string, title string, document_date string"
    return spark.createDataFrame(FILES, schema).withColumn("total", F.lit(0)).withColumn("n", F.lit(0))


def test_inventory_and_scopes(spark, files):
    got = {(r["what"], r["value"]): r["n"] for r in routing.inventory(files).collect()}
    assert got["files", ""] == 4 and got["kind", "-"] == 2 and ("format", None) not in got
    assert {r["domain"]: (r["files"], r["dated"]) for r in routing.families(files).collect()} == {"documents": (3, 2), "data": (1, 1)}
    once = {r["content_id"]: (r["relative_path"], r["domains"], r["paths"]) for r in routing.one_per_content(files).collect()}
    assert once == {"c1": ("a/lettre 2.pdf", ["data", "documents"], 2), "c3": ("c.eml", ["documents"], 1)}
    selected = spark.createDataFrame([("a/lettre 2.pdf", "c1"), ("b/Lettre 10.pdf", "old"), ("x", "c"), ("a/élan.txt", None)], "relative_path string, content_id string")
    assert {r["relative_path"]: r["status"] for r in routing.scope(selected, files).collect()} == {"a/lettre 2.pdf": "current", "b/Lettre 10.pdf": "outdated", "x": "gone", "a/élan.txt": "current"}
    assert routing.inventory(files.where(F.lit(False))).count() == 0


def test_filters(spark, files):
    assert [r["profile_id"] for r in routing.sorted_names(files, 3).collect()] == [4, 3, 1]
    assert {r["profile_id"] for r in files.where(routing.typed_filter(routing.read_typed("pdf 2024 let"))).collect()} == {1, 2}
    assert {r["profile_id"] for r in files.where(routing.typed_filter(routing.Typed())).collect()} == {1, 2, 3, 4}
    ticked = spark.createDataFrame([("a/lettre 2.pdf",), ("a/lettre 2.pdf",)], "relative_path string")
    assert [r["profile_id"] for r in routing.explorer(files, ["documents"], folder="a", ticked=ticked).collect()] == [1]
    types = {r["profile_id"]: r["user_type"] for r in routing.user_types(files, '[{"type": "x", "path": "a", "format": "pdf"}, {"type": "y", "words": ["élan"]}]').collect()}
    assert types == {1: "x", 2: None, 3: "y", 4: None}
    with pytest.raises(ValueError):
        routing.user_types(files, '[{"type": "x", "size": 3}]')


def test_search_in_pages(spark):
    pages = spark.createDataFrame([(1, "f", 1, "Facture rectifiée du jour"), (2, "f", 2, "facture seule"), (3, "g", 1, "la facture, rectifiee"), (4, "h", 1, None), (5, "h", 2, "")], "row_id bigint, path string, page bigint, text string").withColumn("total", F.lit("clash"))
    got = routing.set_search(pages.drop("total"), "path", "text", ["facture", "rectifiee"]).collect()
    assert [(r["path"], r["passages"], r["total"]) for r in got] == [("f", 1, 2), ("g", 1, 2)]
    first = routing.first_passages(pages.drop("total"), "path", "row_id", ["page"], F.col("text").contains("facture"), 1).collect()
    assert {(r["path"], r["row_id"], r["total"]) for r in first} == {("f", 2, 1), ("g", 3, 1)}
    narrow = pages.where("row_id = 1").select("row_id", F.lit(0.5).alias("s"))
    wide = pages.select("row_id", F.lit(0.1).alias("s"))
    assert routing.widened(narrow, wide, "s", 0.4).count() == 1 and routing.widened(narrow, wide, "s").count() == 5 and routing.widened(narrow.where("row_id < 0"), wide, "s").count() == 5
    assert {(r["column"], r["word"], r["value"]) for r in routing.value_words(pages.where("row_id = 2"), ["text"]).collect()} == {("text", "facture", "facture seule"), ("text", "seule", "facture seule")}
    assert [r["row_id"] for r in routing.row_lookup(pages, "FACTURE SEULE", ["text", "path"]).collect()] == [2]


def test_names_in_texts(spark):
    text = "Merci à Mme Anne Roux de la Clinique du Lac, réf. LIL 123-4567. Vu avec Jean Petit Sàrl hier, et Paul Durand aussi."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Anne Roux Anne Roux")], "k bigint, t string").withColumn("source", F.lit("clash"))
    entries = extract.dictionary(spark.createDataFrame([("Anne Roux",)], "n string"), "n")
    got = {(r["k"], r["surface"], r["source"]) for r in extract.document_names(docs, "k", "t", entries, {"dossier": r"\bLIL \d{3}-\d{4}\b"}).collect()}
    assert {(1, "LIL 123-4567", "identifier"), (1, "anne roux", "gazetteer"), (1, "Clinique du Lac", "org_prefix"), (1, "Jean Petit Sàrl", "org_suffix"), (4, "anne roux", "gazetteer")} <= got
    assert not any(s == "Anne" or k in (2, 3) for k, s, _ in got)
    assert extract.document_names(docs, "k", "t", entries, {}, most=1).where("k = 4").count() == 1


def test_profiles(spark):
    fields = [(1, "d", "p", "metadata", "title", " ", "a", 0.9, None), (2, "d", "p", "metadata", "title", "T", "b", None, None), (3, "d", "p", "metadata", "title", "U", "c", 0.1, None), (4, "d", "p", "cells", "title", "V", "c", 1.0, None)]
    df = spark.createDataFrame(fields, "row_id bigint, domain string, relative_path string, kind string, detail string, value string, source string, confidence double, recorded_at timestamp")
    assert [(r["value"], r["source"]) for r in profiles.chosen_fields(df, ["title"]).collect()] == [("U", "c")]
    evidence = spark.createDataFrame([("a", 1, "2024-01-02"), ("a", 0, "x"), ("b", 0, "01.02.2024"), ("b", 0, "2024-02-03"), ("c", 2, None)], "k string, rank int, v string")
    assert {r["k"]: str(r["date"]) for r in profiles.date_of_evidence(evidence, ["k"], "rank", "v").collect()} == {"a": "2024-01-02", "b": "None"}
    docs = spark.createDataFrame([(1, "Objet : une lettre\r\nDate: 3 mai\n" + "x\n" * 20 + "Tard: y"), (2, None)], "k int, t string")
    assert {(r["label"], r["value"]) for r in profiles.header_lines(docs, "k", "t").collect()} == {("objet", "une lettre"), ("date", "3 mai")}


def test_order_needs_an_index(spark):
    df = spark.createDataFrame([(10 * i, float(i % 3)) for i in range(60)], "i bigint, v double").repartition(4)
    sheet = describe(df)
    for kind in ("sort", "largest_row", "filter", "row_at"):
        with pytest.raises(Refusal):
            execute(df, sheet, Operation(kind, "v"))
    assert execute(df, sheet, Operation("row_at", index=59), "i").first()["i"] == 590
    with pytest.raises(Refusal):
        execute(df, sheet, Operation("row_at", index=60), "i")
    assert execute(df, sheet, Operation("largest_row", "v"), "i").first()["i"] == 20 and isinstance(sheet, Sheet)
    assert [(r["column"], r["text"]) for r in row_cells(df.where("i = 10"), "i").collect()] == [("v", "1.0")]

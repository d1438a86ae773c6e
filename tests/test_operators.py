"""Relational, search, finder, knowledge, pipeline, reader and streaming operators on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers, text
from lectern.functions.phonetic import key
from lectern.operators import base, finder, knowledge, pipeline, relational, search
from lectern.sources import delimited, documents, sinks
from lectern.streaming import ingest


def test_redirects(spark):
    r = spark.createDataFrame([(1, None)] + [(i, i - 1) for i in range(2, 40)] + [(50, 50)], "id int, merged_into int")
    roots = dict(relational.follow_redirects(r).collect())
    assert all(roots[i] == 1 for i in range(1, 40)) and roots[50] == 50


def test_redirects_of_any_length(spark):
    r = spark.createDataFrame([(1, None)] + [(i, i - 1) for i in range(2, 301)] + [(500, 900)], "id int, merged_into int")
    roots = dict(relational.follow_redirects(r).collect())
    assert all(roots[i] == 1 for i in range(1, 301)) and roots[500] == 900
    for ring in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (7, 1), (8, None)]):
        with pytest.raises(ValueError):
            relational.follow_redirects(spark.createDataFrame(ring, "id int, merged_into int"))
    assert relational.follow_redirects(r.where("id < 0")).count() == 0


def test_base_reports(spark):
    rows = [(1, "d", "a", 1.0, "Anne Roux", "person", "subject", "cells", 0.9, "cells:F!P"), (2, "d", "b", 2.0, "anne roux", None, None, "cells", None, None), (3, "t", None, 3.0, " ", "person", "issuer", "x", 1.5, "header"), (4, None, "c", None, None, None, "subject", None, 0.1, None), (4, "d", "a", 1.0, "Anne Roux", "person", "odd", "cells", 0.9, "cells:F!P")]
    m = spark.createDataFrame(rows, "row_id bigint, domain string, relative_path string, entity_id double, surface string, type_id string, role string, source string, confidence double, locator string").withColumn("id", F.lit(0)).withColumn("root", F.lit(0))
    files = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "z")], "domain string, relative_path string")
    assert {(r["id"], r["root"]) for r in base.survivors(m).collect()} == {(1, 1), (2, 1), (3, 3)}
    redirects = spark.createDataFrame([(1, 9), (2, 2), (3, 1), (3, 2)], "id int, merged_into int")
    broken = dict(base.integrity(m, files, redirects).collect())
    assert broken == {"blank_surface": 2, "missing_type": 2, "missing_role": 1, "confidence_out_of_range": 1, "missing_path": 1, "repeated_key": 1, "dangling_mention": 2, "repeated_file": 1, "redirect_to_nothing": 1, "redirect_to_itself": 1, "several_redirects": 1}
    assert dict(base.health(m, files).collect())["files_without_entity"] == 1
    assert {(r["entity_id"], r["sources"]) for r in base.supporting_sources(m).collect()} == {(1, 2), (3, 0)}
    assert base.overview(m.where("row_id < 0")).first()["entities"] == 0 and base.facet(m.where("row_id < 0"), spark.createDataFrame([], "kind string, value string, domain string, relative_path string")).count() == 0


def test_upsert_and_friends(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "k int, v string")
    assert sorted(relational.upsert(a, b.distinct(), ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(relational.insert_or_ignore(a, b, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(relational.replace_documents(a, b, "k").collect()) == [(1, "a"), (2, "B"), (3, "c"), (3, "c")]


def test_packed(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 5, 3, 20, 1])], "i int, s int").coalesce(1)
    got = [r["batch"].split("-")[1] for r in relational.packed(df, F.col("i"), "s", 2, 10).orderBy("i").collect()]
    assert got == ["0", "0", "1", "2", "3"]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", i, 1.0 - i / 10, s) for i, s in enumerate([50, 60, 30, 20, 1])], "q string, k int, score double, n int")
    got = [(r["k"], r["place"]) for r in search.within_budget(df, "q", "k", "n", most=3, chars=100).orderBy("place").collect()]
    assert got == [(0, 1), (2, 2), (3, 3)]


def test_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, []), (4, None), (5, [0.0, 0.0]), (6, [1.0, 1.0])], "k int, v array<float>")
    got = {r["k"]: round(r["cosine"], 4) for r in search.cosine(df, "k", "v", [2.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.7071}


def test_text(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(text.fold(F.lit("Élève ÇA"))) == "eleve ca" and one(text.fold_word(F.lit("Œuvre n° 1"))) == "oeuvren1"
    assert one(text.spaced_words(F.lit("montantTotal_HT"))) == "montant total ht"
    assert one(text.split_sentences(F.lit("M. Dupont va bien. Le Dr. Roux vient. Fin"))) == ["M. Dupont va bien.", "Le Dr. Roux vient.", "Fin"]
    assert one(text.placeholders(F.lit("{{nom}}, «ville» [12] [date] {{nom}}"))) == ["nom", "ville", "date"]
    assert one(text.clean_inline(F.lit("**a** [b](c) `d` _e_"))) == "a b d e"
    assert one(text.sanitize_file_name(F.lit("Été: à/b?.pdf"))) == "ete-a-b-.pdf"
    assert one(numbers.dates_in_text(F.lit("le 3 mars 2024 et 2024-05-06, 1.2.2023"))) == ["2024-05-06", "2023-02-01", "2024-03-03"]
    assert one(numbers.unsupported_numbers(F.lit("Total 1 250,50 et 33"), F.array(F.lit("1250.50")))) == ["33"]
    assert text.osa_distance("martin", "mratin", 1) == 1 and text.osa_distance("abc", "xyz", 2) is None
    assert numbers.cardinal(71, "fr") == "soixante et onze" and numbers.cardinal(1234) == "one thousand two hundred thirty-four"
    assert key("dupont") == key("dupond") and key("smith", "en") == key("smyth", "en")


def test_resolution(spark):
    base = spark.createDataFrame([(1, "Anne Martin"), (2, "Paul Durand"), (3, "Paul Durand")], "id int, name string")
    q = spark.createDataFrame([("Mme Anne Martin",), ("Martin Anne",), ("Anne Martim",), ("Paul Durand",), ("Zoé",)], "name string")
    got = {r["name"]: (r["signal"], r["outcome"]) for r in knowledge.resolve(q, base).collect()}
    assert got["Mme Anne Martin"] == ("exact", "resolved") and got["Martin Anne"] == ("token_set", "resolved")
    assert got["Paul Durand"] == ("exact", "ambiguous") and got["Zoé"] == ("none", "unknown")


def test_sections(spark):
    p = spark.createDataFrame([("d", i) for i in range(6)], "d string, at int")
    s = spark.createDataFrame([("d", 2, "x"), ("d", 4, "y")], "d string, at int, title string")
    got = {r["at"]: r["section_title"] for r in pipeline.assign_sections(p, s, "d", ["at"]).collect()}
    assert got == {2: "x", 3: "x", 4: "y", 5: "y"}


def test_chunkers():
    parts = pipeline.pack_short("\n\n".join(["é" * 300] * 5 + ["fin"]))
    assert all(len(p.encode()) <= 1200 + 210 for p in parts) and "".join(parts).count("é") == 1500 and parts[-1].endswith("fin")
    long = "Une phrase assez longue pour couper. " * 200
    assert all(len(c) <= 1200 for c in pipeline.pack_long(long)) and "".join(c + " " for c in pipeline.pack_long(long)).split() == long.split()


def test_delimited(spark, tmp_path):
    assert delimited.delimiter_of("a;b\n1,5;2\n") == ";" and delimited.delimiter_of("a,b\n1,2\n") == "," and delimited.decode("é".encode("cp1252")) == "é"
    (tmp_path / "x.csv").write_bytes("titre\n\nDate;M\n1;\"a\nb\"\n".encode("cp1252"))
    rows = delimited.read_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r["source_row"], r["cells"]) for r in rows] == [(1, ["titre"]), (3, ["Date", "M"]), (4, ["1", "a\nb"])]


def test_readers(spark, tmp_path):
    assert documents.strip_html("<p>a&amp;b<script>x</script></p><p>c</p>") == "a&b\n\nc"
    assert documents.read_rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 X;}}caf\'e9\par \u233?t\b gras}") == ["café\nétgras"]
    mail = b"From: a@b.example\nSubject: =?utf-8?q?=C3=A9t=C3=A9?=\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nY2Fmw6k=\n"
    assert documents.read_mail(mail) == ["From: a@b.example\nSubject: été\n\ncafé"]
    vtt = b"WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ann>Hi\n\n00:03.000 --> 00:04.000\n<v Ann>you"
    assert documents.read_captions(vtt) == ["[00:00:01] Ann: Hi you"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>un</w:t></w:r></w:p><w:p><w:r><w:t>deux</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r["path"][-6:]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "un\ndeux" and got["b.docx"]["error"].startswith("BadZipFile")


def test_finder(spark):
    f = spark.createDataFrame([("a/b/2024-01-02_Courrier.pdf",), ("a/courrier.txt",), ("c.txt",)], "p string")
    assert {r["folder"]: r["files"] for r in finder.folders(f, "p").collect()} == {"a": 2, "a/b": 1}
    assert [r["reason"] for r in finder.resolve_reference(f, "p", "COURRIER.TXT").collect()] == ["name_any_case"]


def test_mail_merge(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 2), (3, "a", "x", 3)], "i int, k string, same string, line int")
    assert [r["key"] for r in sinks.first_appearance_groups(rows, "k", "i").collect()] == ["a", "b"]
    assert sinks.line_columns(rows, "k") == ["i", "line"]
    assert sinks.propose_mapping(["Nom", "Vil", "Zz"], ["nom", "ville"]) == [("Nom", "nom", "exact"), ("Vil", "ville", "proposed"), ("Zz", None, "unresolved")]


def test_ring_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), None if i % 2 else "r") for i in range(10)], "i int, v double, r string")
    r = ingest.diagnostics(df, "i", "v", "r", 4).first()
    assert (r["n"], r["with_reason"], r["upper_median"]) == (4, 2, 8.0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("un")
    for expected in (1, 2):
        ingest.stream_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (tmp_path / "in" / "b.txt").write_text("deux")
    import os
    import time

    (tmp_path / "in" / "a.txt").write_text("trois")
    os.utime(tmp_path / "in" / "a.txt", (time.time() + 60, time.time() + 60))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    ingest.stream_folder(spark, source, target, str(tmp_path / "cp")).awaitTermination()
    for _ in range(2):
        ingest.refresh_folder(spark, source, target)
        assert {r["text"] for r in ingest.folder_texts(spark, target).collect()} == {"trois", "deux"}
    (tmp_path / "in" / "b.txt").unlink()
    ingest.refresh_folder(spark, source, target)
    assert {r["text"] for r in ingest.folder_texts(spark, target).collect()} == {"trois"}


def test_exact_order_statistics(spark, monkeypatch):
    from lectern.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "RANGES", 4)
    values = [1e300, -1e300, 0.0, -0.5, 2.5, 2.5, 2.5, 7.0, 1e-9, 3.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("n", F.lit(1))
    real = sorted(v for v in values if v is not None and v == v)
    assert [quantiles.value_at(df, "v", i) for i in range(len(real))] == real and quantiles.value_at(df, "v", len(real)) is None
    assert quantiles.median(df, "v") == 2.5 and quantiles.percentile(df, "v", 0.95) == 1e300 and quantiles.median(df.where("v > 1e301"), "v") is None


def test_fill_reads_the_template_once(spark):
    rows = spark.createDataFrame([("«b»", "x"), (None, "y")], "a string, b string")
    got = [r["letter"] for r in sinks.fill("{{a}} {{ b }} «b» [c] [a]!", rows, {"a": "a", "b": "b"}).collect()]
    assert got == ["«b» x x [c] «b»!", " y y [c] !"]
    assert sinks.line_columns(spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", None)], "k int, u string, v string"), "k") == ["v"]


def test_reduction_falls_back_to_all_files(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(20)], "relative_path string")
    links = spark.createDataFrame([(f"f{i}", "Anne Roux", 0.9) for i in range(3)] + [(f"f{i}", "Le Lac", 0.9) for i in range(19)] + [("f4", "Unsure", 0.1)], "relative_path string, surface string, confidence double")
    got = {r["relative_path"]: r["reason"] for r in knowledge.reduce_files(links, ["anne roux"], files).collect()}
    assert got == {"f0": "entity", "f1": "entity", "f2": "entity", "f19": "unread"}
    for asked in (["le lac"], ["unsure"], ["nobody"], []):
        assert {r["reason"] for r in knowledge.reduce_files(links, asked, files).collect()} == {"all"}
    assert knowledge.reduce_files(links, ["anne roux"], files.limit(5)).count() == 5


def test_near_pairs(spark):
    df = spark.createDataFrame([(w,) for w in ["martin", "matrin", "marten", "dupont", "", None, "martin"]], "w string")
    assert {tuple(r) for r in text.near_pairs(F.col("w"), df).collect()} == {("martin", "matrin", 1), ("marten", "martin", 1), ("marten", "matrin", 2)}


def test_nearest(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(90, None), (91, [0.0, 0.0])], "k bigint, v array<double>")
    got = search.nearest(df, "k", "v", df.where("k in (0, 10)"), 3, block=7).collect()
    assert {(r["query"], r["k"]) for r in got} == {(0, 0), (0, 1), (0, 2), (10, 10), (10, 11), (10, 9)}


def test_extraction(spark):
    from lectern.operators import extract

    docs = spark.createDataFrame([(1, "Lettre à Anne Roux et Anne Roux Petit, LIL 123-4567."), (2, None), (3, ""), (4, "x" * 50_000)], "k bigint, t string").withColumn("run", F.lit(0)).withColumn("at", F.lit(0))
    entries = extract.dictionary(spark.createDataFrame([("Anne Roux",), ("anne roux petit",), ("Roux",), (None,), ("a b c d e f",)], "n string"), "n")
    hits = {(r["at"], r["run"]) for r in extract.longest_matches(docs, "k", "t", entries).collect()}
    assert hits == {(3, "anne roux"), (4, "roux"), (6, "anne roux petit"), (7, "roux")}
    assert {(r["at"], r["run"]) for r in extract.apart(extract.longest_matches(docs, "k", "t", entries), "k").collect()} == {(3, "anne roux"), (6, "anne roux petit")}
    stripped = {r["k"]: r["t"] for r in extract.strip_known(docs, "k", "t", entries).withColumnRenamed("text", "t").collect()}
    assert stripped[1] == "lettre a [NOM] et [NOM] lil 123 4567" and stripped[2] is None and stripped[3] == ""
    ids = extract.scan_identifiers(docs, "k", "t", {"dossier": r"\bLIL \d{3}-\d{4}\b"}).collect()
    assert [(r["k"], r["compact"]) for r in ids] == [(1, "LIL1234567")]
    with pytest.raises(ValueError):
        extract.load_pack('{"other": 1}')


def test_routes():
    from lectern.operators import routing

    assert routing.follow_up("et en 2024 ?", "Combien de lettres ?") == "Combien de lettres ? et en 2024 ?" and routing.follow_up("a b c d e f g h i", "x") == "a b c d e f g h i"
    assert routing.read_typed("pdf 03/2024 Été") == routing.Typed(["pdf"], "2024-03", ["ete"])


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "un scanner du genou"), (2, "scanner scanner"), (3, None), (4, ""), (5, "autre chose"), (6, "encore autre"), (7, "rien")], "k bigint, t string").withColumn("term", F.lit(0))
    index = search.PostingsIndex.build(docs, "k", "t", str(tmp_path / "index"))
    both = [{r["k"]: round(r["score"], 9) for r in found.collect()} for found in (index.bm25("k", ["scanner", "genou"]), search.bm25(docs, "k", "t", ["scanner", "genou"]))]
    assert both[0] == both[1] and set(both[0]) == {1, 2}
    assert {r["k"] for r in index.bm25("k", ["scanner"], docs.where("k > 1")).collect()} == {2} and index.bm25("k", ["nichts"]).count() == 0


def test_overlap_join(spark):
    import random
    from datetime import date, timedelta

    rng = random.Random(2)
    day = lambda: date(2024, 1, 1) + timedelta(rng.randint(0, 400))
    a, b = [(i, day(), day()) for i in range(60)] + [(99, None, day())], [(i, day(), day()) for i in range(60)] + [(98, day(), None)]
    left, right = spark.createDataFrame(a, "i int, f date, t date"), spark.createDataFrame(b, "j int, u date, v date")
    want = {(i, j) for i, f, t in a for j, u, v in b if None not in (f, t, u, v) and f <= t and u <= v and f <= v and u <= t}
    got = [(r["i"], r["j"]) for r in relational.overlap_join(left, right, "f", "t", "u", "v", 9).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_spoken():
    from lectern.functions import spoken

    assert spoken.spoken("Le 1er mai 2024 à 14:05, 3,05 mg et CHF 1'200.50") == "Le premier mai deux mille vingt-quatre à quatorze heures cinq, trois virgule zéro cinq milligrammes et mille deux cents virgule cinquante francs"
    assert spoken.spoken("Am 03.02.2023 um 079 555 23 07", "en") == "Am February third, two thousand twenty-three um zero seven nine five five five two three zero seven"
    assert [spoken.ordinal(n) for n in (1, 3, 4, 5, 21, 80)] == ["premier", "troisième", "quatrième", "cinquième", "vingt et unième", "quatre-vingtième"]
    assert [spoken.ordinal(n, "en") for n in (1, 3, 12, 20, 21, 40)] == ["first", "third", "twelfth", "twentieth", "twenty-first", "fortieth"]
    assert spoken.spoken("") == "" and spoken.spoken("AB12 v1.2.3") == "AB12 v1.2.3"


def test_ports(spark):
    from lectern.sources import ports

    calls = []

    def reader(image):
        if image == b"bad":
            raise ValueError("no page")
        return image.decode(), 0.9 if len(image) > 3 else 0.3

    pages = spark.createDataFrame([(1, bytearray(b"long page")), (2, bytearray(b"ab")), (3, bytearray(b" ")), (4, bytearray(b"bad")), (5, None)], "k int, image binary")
    assert {r["k"]: r["status"] for r in ports.recognised(pages, "k", "image", reader).collect()} == {1: "recognised", 2: "below_threshold", 3: "no_text", 4: "error"}
    images = ports.rasterised(pages.withColumnRenamed("image", "content"), "k", "content", lambda c: [c[:1], c[1:]] if c != b"bad" else 1 / 0).collect()
    assert sum(r["error"] is not None for r in images) == 1 and len(images) == 7
    assert ports.batches([10] * 40) == [16, 16, 8] and ports.batches([30_000, 1, 19_999, 1]) == [1, 2, 1] and ports.batches([]) == []
    got = ports.embedded(spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string"), "k", "t", lambda ts: [[float(len(t))] for t in ts]).collect()
    assert [(r["k"], list(r["embedding"])) for r in got] == [(1, [2.0])]
    assert list(ports.server_events(iter(["a", "é"]), "x"))[1:] == ['data: {"id": "x", "delta": "é"}\n\n', "data: [DONE]\n\n"] and not calls


def test_office_files():
    from lectern.plans import inputs
    from lectern.sources import office

    assert office.read_pdf(inputs.make_pdf("un (deux) \\ trois", "é")) == ["un (deux) \\ trois", "é"]
    with pytest.raises(ValueError):
        office.read_pdf(b"%PDF-1.4 /Encrypt 1 0 R")
    assert office.read_metadata("md", b"---\ntitle: Un titre\nauthor:\n---\ntexte") == {"title": "Un titre"}
    assert office.read_metadata("pdf", b"%PDF-1.4 << /Title (Un) /CreationDate (D:20240301120000) >>") == {"title": "Un", "created": "2024-03-01"}
    assert office.read_metadata("txt", b"x") == {}


def test_cascade(spark):
    from lectern.operators import profiles

    base = spark.createDataFrame([(1, "Anne Roux"), (2, "Jean Petit"), (3, "Jean Petit"), (4, "Paul Durand")], "id bigint, name string")
    aliases = spark.createDataFrame([(1, "La Rousse")], "id bigint, alias string")
    stop = spark.createDataFrame([("Lausanne",)], "name string")
    asked = ["Mme Anne Roux", "roux anne", "la rousse", "A. Roux", "Durand", "Petit", "Jean Petit", "Lausanne", "Paul Durant", "Zed", None]
    got = {r["name"]: (r["id"], r["signal"], r["outcome"]) for r in profiles.resolve_cascade(spark.createDataFrame([(a,) for a in asked], "name string"), base, aliases, stop).collect()}
    assert got == {
        "Mme Anne Roux": (1, "canonical", "resolved"), "roux anne": (1, "swapped", "possible"), "la rousse": (1, "alias", "resolved"), "A. Roux": (1, "initial", "possible"), "Durand": (4, "surname", "possible"),
        "Petit": (None, "surname", "ambiguous"), "Jean Petit": (None, "canonical", "ambiguous"), "Lausanne": (None, "suppressed", "suppressed"), "Paul Durant": (4, "fuzzy", "possible"), "Zed": (None, "none", "unknown"),
    }

"""Names, personal information and repairs."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import names, ocr, pii


def pairs_of(*groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_names(spark):
    anne = ["Anne-Lise Uldremont", "ULDREMONT Anne-Lise", "Uldremont, Anne Lise", "Dre A.-L. Uldremont", "Annelise Uldrement"]
    rachel, jo = ["Rachel Crorrotard", "CRORROTARD, Rachel", "R. Crorrotard"], ["Joséphine Crorrotard", "Jo Crorrotard"]
    lab, clinic = ["Laboratoire de Cachotet SA", "Labo Cachotet", "Cachotet (Laboratoire)", "LABORATOIRE DE CACHOTET"], ["Clinique de Cachotet"]
    rows = [(s, "person", None) for s in anne + rachel + jo] + [(s, "organization", None) for s in lab + clinic] + [("Rachel Crorrotard", None, 7.0), (None, "person", 1.0), ("", "person", None), ("Verbriney", "location", None), ("x" * 5000, None, None)]
    df = spark.createDataFrame(rows * 2, "surface string, type_id string, entity_id double").withColumn("root", F.lit("clash"))
    got = [tuple(r) for r in names.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(anne, rachel, jo, lab)
    assert names.pairs(df.where(F.lit(False))).count() == 0


def test_spellings_that_meet_through_a_rarer_one(spark):
    # the outer two are two edits apart; the middle one is a slip of both, by different scores
    chain = [("Sabine Vuldremont", 5), ("Sabine Vuldrement", 1), ("Sabine Ruldrement", 3)]
    rows = [(s, "person", None) for s, n in chain for _ in range(n)]
    df = spark.createDataFrame(rows, "surface string, type_id string, entity_id double")
    assert {tuple(r) for r in names.pairs(df).collect()} == pairs_of([s for s, _ in chain])
    ids = {"Sabine Vuldremont": 1.0, "Sabine Ruldrement": 2.0}
    known = spark.createDataFrame([(s, t, ids.get(s)) for s, t, _ in rows], df.schema)
    assert {tuple(r) for r in names.pairs(known).collect()} == pairs_of(["Sabine Vuldremont", "Sabine Vuldrement"])


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(30)] + [("x", "y")]
    got = {r["node"]: r["root"] for r in names.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got["030"] == "000" and got["y"] == "x" and len(got) == 33


def test_similarity():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.edits("ab", "ba") == 1 and names.alike("fellamoud", "felamoud") > 0 and not names.alike("dubois", "dupont")
    assert names.same_given("jo", "full", "josephine", "full") and not names.same_given("marie", "full", "maria", "full")


FORMS = [
    ("email", "écrire à jean.roux+x@poste.example ou non", "jean.roux+x@poste.example"), ("email", "mail a_b3 [at]\nsante-nord.example.", "a_b3 [at] sante-nord.example"), ("phone", "au +41 (0)21 555 66\n78 avant", "+41 (0)21 555 66 78"),
    ("phone", "Tél. 079/555.24.5l, x", "079/555.24.5l"), ("id_number", "n° 756.1234.O567.89, y", "756.1234.O567.89"), ("id_number", "sous 2 94 04 99 761 953 99.", "2 94 04 99 761 953 99"), ("id_number", "carte X1234567.", "X1234567"),
    ("address", "Domicile : 12 bis, rue des Lilas, 1234 Monville.", "12 bis, rue des Lilas, 1234 Monville"), ("address", "Wohnort: Lilasstrasse 7, 1234 Monville.", "Lilasstrasse 7, 1234 Monville"), ("address", "habite Place de la\nPaix 3A, CH-1234 Saint-ville et", "Place de la Paix 3A, CH-1234 Saint-ville"),
    ("name", "Merci de rappeler Mme Sabine Roux au", "Sabine Roux"), ("name", "vu par le Dr ROUX hier", "ROUX"), ("name", "Les parents, Marion Petit et ROUX Hugo, ont", "ROUX Hugo"), ("name", "Identité : M. Petit, Hugo, né", "Petit, Hugo"),
]


@pytest.mark.parametrize(("kind", "text", "found"), FORMS)
def test_forms(kind, text, found):
    got = {(k, " ".join(text[a:b].split())) for k, a, b, *_ in pii.candidates(text)}
    assert (kind, found) in got


@pytest.mark.parametrize("text", ["le 01.07.2024 10 h", "dossier LIL 544-5617", "réf. XR-371674", "CHF 1'234.50", "Laboratoire de Cachotet SA", "à Verbriney le 3 mai 2024"])
def test_look_alikes(text):
    assert [c for c in pii.candidates(text) if c[0] != "name" or c[5] in ("titled", "given")] == []


def test_redaction(spark):
    rows = [(i, "Copie à Mme Sabine Roux (s.roux@poste.example). Rien d'autre.") for i in range(5)] + [(9, "Copie à Zorglub hier."), (10, None), (11, ""), (12, "x" * 100_000)] + [(20 + i, "Bonjour. Le dossier suit. Voir la suite.") for i in range(5)]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = {r["row_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got[0] == "Copie à Mme [NAME] ([EMAIL]). Rien d'autre." and got[9] == "Copie à [NAME] hier."
    assert got[10] is None and got[11] == "" and got[12] == "x" * 100_000
    assert pii.mentions(df.where(F.lit(False))).count() == 0


def test_given_names_are_learned(spark):
    given, surnames = ["Albane", "Ciro", "Dovi", "Elke"], ["Muradoz", "Tessinard", "Vobrel", "Zanquet", "Pirolat", "Quintard", "Ruvelin"]
    rows = [(10 * i + j, f"On a vu Mme {g} {s.upper()} hier avec le dossier.") for i, g in enumerate(given) for j, s in enumerate(surnames)]
    rows += [(900 + i, f"Merci de rappeler {s.upper()} {g} demain.") for i, (g, s) in enumerate(zip(given, surnames, strict=False))]
    rows += [(950 + i, f"Le Dossier LIL {i} suit. Le Bilan est fait. Dans la Salle {i} on attend.") for i in range(40)]
    rows += [(990, "Bilan Mme Vobrel Dossier LIL")]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    found = {(r["row_id"], r["found"]) for r in pii.mentions(df, listed=False).collect()}
    assert {(900 + i, f"{s.upper()} {g}") for i, (g, s) in enumerate(zip(given, surnames, strict=False))} <= found
    assert not [f for _, f in found if "Dossier" in f and "LIL" in f]


def test_disclosure_decides_for_every_form(spark):
    rows = [(i, f"Le compte de Mme Sabine Roux est clos, dossier {i}.") for i in range(6)]
    rows += [(100 + i, f"On note ({w}) Punkt {i} en ordre.") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(200, "On note (z) Punkt Hugo en ordre.")]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    by_form = {r["form"]: (r["candidates"], r["removed"], r["kept"]) for r in pii.decided(df).collect()}
    assert by_form["titled"] == (6, 6, 0) and by_form["given"] == (1, 0, 1) and by_form["alone"][1] == 0
    assert 200 not in {r["row_id"] for r in pii.mentions(df).collect()}


def test_cost():
    assert ocr.cost("lombaire", "lornbaire") == 1 and ocr.cost("dossier", "dossier") == 0 and ocr.cost("dossier", "dosxier") == 99
    assert ocr.skeleton("Cabinet Graserney") == ocr.skeleton("Cabmet Graserriey")


def test_short_words_and_numbers(spark):
    rows = [(i, f"f{i}", 1, "voir la réf du dossier et le bilan à refaire avec soin") for i in range(30)] + [(50, "g", 1, "poser rien"), (51, "h", 1, "rien demain")]
    rows += [(60, "x", 1, "voir la r6f du dossier"), (61, "y", 1, "le l6 mars, 999,9O francs et 1O jours"), (63, "w", 1, "au 12b rue Haute, 99S")]
    df = spark.createDataFrame(rows, "row_id bigint, relative_path string, page_number bigint, text string")
    fixed = {r["row_id"]: r["text"] for r in ocr.repaired(df).collect()}
    assert fixed[60] == "voir la réf du dossier" and fixed[61] == "le 16 mars, 999,90 francs et 10 jours"
    assert fixed[63] == "au 12b rue Haute, 99S"
    found = {r["row_id"] for r in ocr.defects(df).where("defect = 'misread'").collect()}
    assert {60, 61} <= found and 63 not in found
    _, two = ocr.lexicon(ocr.pages(df, "row_id", "text", "relative_path", "page_number", None))
    assert two.where("p = 'poser' and w = 'rien'").first()["n"] == 1


def test_long_words_lines_and_deep_headers(spark):
    long = "abcdefghij" * 40  # one word, far longer than deletions are made of
    head = "Cabinet médical du Lac, " + "service des consultations et des urgences, " * 6
    own = ["Vert", "Bleu", "Rouge", "Jaune", "Blanc", "Noir", "Gris", "Brun"]
    rows = [(i, f"f{i % 2}.pdf", i // 2 + 1, f"{head}{'ab'[i % 2]}\nDossier du patient suivi {'xy'[i % 2]}\nCopie pour information interne\n{own[i // 2]} début {i}.\nun {long} ici\ntexte\nautre {i}\n{own[i // 2]} fin") for i in range(16)]
    rows += [(50, "z", 1, f"mot {long[:150]}c1{long[151:]} là"), (51, "z", 2, "@" * 30_000 + " fin"), (52, "y", 1, "un " + "mot-" * 40 + "consul-\ntation prévue")]
    rows += [(60 + i, f"q{i}", 1, "la consultation prévue") for i in range(8)]
    df = spark.createDataFrame(rows, "row_id bigint, relative_path string, page_number bigint, text string")
    marks = ocr.defects(df).collect()
    headers = {(r["row_id"], r["a"]) for r in marks if r["defect"] == "running_header"}
    top = len(rows[0][3].split("\n")[0])
    assert len(head) > 110 and (0, 0) in headers and (0, top + 1) in headers
    third = top + 1 + len(rows[0][3].split("\n")[1]) + 1
    assert (0, third) in headers and not any(r == 0 and third < a < third + 60 for r, a in headers)
    seen = long[:150] + "c1" + long[151:]
    assert ocr.cost(long, seen) == 99 or any(r["row_id"] == 50 and r["repair"] == long for r in marks)
    assert ocr._mails("a b@c d@e.ch f x@@y z") == [(2, 5), (6, 12), (15, 19)] or ocr._mails("écrire à a@b.ch ou") == [(9, 15)]
    assert ocr.last_word("x" * 300 + "-", 300) == "x" * 300


def test_segments_find_two_edits():
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abcdelnmuo") for _ in range(rng.randint(65, 90)))
        seen = word
        for _ in range(2):
            printed, glyphs = rng.choice(ocr.CONFUSIONS)
            at = seen.find(printed, rng.randrange(len(seen)))
            seen = seen if at < 0 else seen[:at] + glyphs + seen[at + len(printed) :]
        assert set(ocr.segments(word, 0)) & set(ocr.segments(seen, 2))


def test_pages(spark):
    body = "le dossier de la personne est complet et la consultation reste prévue pour la semaine"
    own = ["Première page", "Deuxième texte", "Troisième avis", "Quatrième note", "Dernière lettre"]
    rows = [(i, f"f{i % 6}.pdf", i // 6 + 1, f"Cabinet du Lac — dossier AB-{i % 6}77\n{own[i // 6]} {i}.\n{body}\n\n{body}\n{own[i // 6]} fin {i}.\nPage {i // 6 + 1}/5") for i in range(30)]
    rows += [(100, "z.pdf", 1, f"{body} et la consul-\ntation de la pers0nne est prévue\n- 1 -"), (101, "z.pdf", 2, None), (102, None, None, ""), (103, "z.pdf", 3, "l" * 50_000)]
    df = spark.createDataFrame(rows, "row_id bigint, relative_path string, page_number bigint, text string").withColumn("defect", F.lit("clash"))
    got = {(r["row_id"], r["defect"]) for r in ocr.defects(df).select("row_id", "defect").distinct().collect()}
    assert {(0, "running_header"), (0, "page_number"), (100, "hyphenation"), (100, "misread"), (100, "page_number")} <= got
    assert not {(0, "misread"), (0, "hyphenation"), (100, "running_header")} & got and not any(i in (101, 102, 103) for i, _ in got)
    fixed = {r["row_id"]: r["text"] for r in ocr.repaired(df).collect()}
    assert fixed[100] == f"{body} et la consultation de la personne est prévue" and fixed[0] == f"Première page 0. {body}\n\n{body} Première page fin 0." and fixed[101] is None and fixed[102] == ""
    assert ocr.defects(df.where(F.lit(False))).count() == 0

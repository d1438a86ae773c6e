"""Queries that answer questions about the folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import routing, search
from lectern.plans import query_plan
from lectern.plans.ast import Filter, Operation
from lectern.plans.base import _FOLD, _WORDS
from lectern.plans.catalog import query
from lectern.plans.compile import describe, execute
from lectern.plans.question import classify
from lectern.session import table

_NAME = "regexp_extract(relative_path, '([^/]*)$', 1)"

#: Questions as people ask them and the way each goes.
ROUTES = [
    ("Que dit 2024-03-01_courrier.pdf ?", "file", "2024-03-01_courrier.pdf"),
    ("Quels documents parlent de la facture rectifiée ?", "set", "facture rectifiee"),
    ("Which letters mention chest pain?", "set", "chest pain"),
    ("Combien de fichiers y a-t-il ?", "inventory", "combien de fichiers y a-t-il ?"),
    ("Quel est le dernier courrier reçu ?", "rank", "latest"),
    ("What is the oldest report?", "rank", "earliest"),
    ("Résume chaque document", "per_document", ""),
    ("De quoi s'agit-il ?", "global", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in ROUTES) + ") AS t(question, kind, subject)")
def r_routes(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the way each goes; they are parameters, so no table is read."""
    rows = [(q, routing.route(q).kind, routing.route(q).subject) for q, _, _ in ROUTES]
    return spark.createDataFrame(rows, "question string, kind string, subject string")


@query(f"WITH h AS (SELECT relative_path, count(*) AS passages FROM ocr_page_cache WHERE list_contains({_WORDS.format('text')}, 'facture') AND list_contains({_WORDS.format('text')}, 'rectifiee') GROUP BY 1) SELECT relative_path, passages, (SELECT count(*) FROM h) AS total FROM h ORDER BY passages DESC, relative_path LIMIT 50")
def r_set_search(spark: SparkSession, d: str) -> DataFrame:
    """Which files talk about something: the words of the question's subject in their pages."""
    subject = routing.route(routing.follow_up("Quels documents parlent de la facture rectifiée ?", None)).subject
    return routing.set_search(table(spark, d, "ocr_page_cache"), "relative_path", "text", subject.split())


@query(f"WITH h AS (SELECT relative_path, row_id, row_number() OVER (PARTITION BY relative_path ORDER BY page_number, row_id) AS nth, count(*) OVER (PARTITION BY relative_path) AS total FROM ocr_page_cache WHERE list_contains({_WORDS.format('text')}, 'patient')) SELECT * FROM h WHERE nth <= 20")
def r_first_passages(spark: SparkSession, d: str) -> DataFrame:
    """Each file's first pages on a word, twenty at most, with how many it has."""
    from lectern.functions.text import words_of

    return routing.first_passages(table(spark, d, "ocr_page_cache"), "relative_path", "row_id", ["page_number"], F.array_contains(words_of(F.col("text")), "patient"))


@query(f"WITH f AS (SELECT domain, relative_path FROM file_profiles WHERE list_contains({_WORDS.format('title')}, 'lil')) SELECT domain, relative_path, count(*) OVER (PARTITION BY domain) AS total FROM f")
def r_both_domains(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tables whose title has a word, with each side's total."""
    from lectern.functions.text import words_of

    return routing.both_domains(table(spark, d, "file_profiles"), F.array_contains(words_of(F.col("title")), "lil"))


@query(f"SELECT profile_id FROM file_profiles WHERE format IN ('pdf') AND starts_with(document_date, '2024') AND len(list_filter({_WORDS.format(_NAME)}, lambda x: starts_with(x, 'cour'))) > 0")
def r_typed(spark: SparkSession, d: str) -> DataFrame:
    """What a search box's text means: a format, a year, the start of a word."""
    return table(spark, d, "file_profiles").where(routing.typed_filter(routing.read_typed("PDF 2024 cour"))).select("profile_id")


@query("SELECT 'files' AS what, '' AS value, count(*) AS n FROM file_profiles UNION ALL SELECT 'state', state, count(*) FROM file_profiles WHERE state IS NOT NULL GROUP BY 2 UNION ALL SELECT 'format', format, count(*) FROM file_profiles WHERE format IS NOT NULL GROUP BY 2 UNION ALL SELECT 'kind', coalesce(business_type, '-'), count(*) FROM file_profiles GROUP BY 2")
def r_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The inventory in numbers."""
    return routing.inventory(table(spark, d, "file_profiles"))


@query("SELECT domain, count(*) AS files, count(*) FILTER (state = 'analysed') AS analysed, count(*) FILTER (state = 'unreadable') AS unreadable, count(*) FILTER (state = 'empty') AS empty, count(document_date) AS dated FROM file_profiles GROUP BY 1")
def r_families(spark: SparkSession, d: str) -> DataFrame:
    """Counts by family."""
    return routing.families(table(spark, d, "file_profiles"))


@query("SELECT content_id, min_by(relative_path, (domain <> 'documents', relative_path)) AS relative_path, list_sort(list(DISTINCT domain)) AS domains, count(*) AS paths FROM file_profiles WHERE content_id IS NOT NULL GROUP BY 1")
def r_one_per_content(spark: SparkSession, d: str) -> DataFrame:
    """Files of both roots, each content once."""
    return routing.one_per_content(table(spark, d, "file_profiles"))


@query("SELECT o.relative_path, p.domain, p.title, p.business_type, p.state FROM (SELECT DISTINCT relative_path FROM ocr_page_cache) o LEFT JOIN file_profiles p ON o.relative_path = p.relative_path")
def r_with_profile(spark: SparkSession, d: str) -> DataFrame:
    """Scanned files with what their profile says."""
    return routing.with_profile(table(spark, d, "ocr_page_cache").select("relative_path").distinct(), table(spark, d, "file_profiles"))


@query("SELECT o.relative_path, CASE WHEN p.relative_path IS NULL THEN 'gone' WHEN p.content_id IS NOT DISTINCT FROM o.sha256 THEN 'current' ELSE 'outdated' END AS status FROM (SELECT DISTINCT relative_path, sha256 FROM ocr_page_cache) o LEFT JOIN file_profiles p ON o.relative_path = p.relative_path")
def r_scope(spark: SparkSession, d: str) -> DataFrame:
    """A selection, here all scans read, against the files now there."""
    selected = table(spark, d, "ocr_page_cache").select("relative_path", F.col("sha256").alias("content_id")).distinct()
    return routing.scope(selected, table(spark, d, "file_profiles"))


@query(f"SELECT profile_id FROM file_profiles ORDER BY array_to_string(list_transform(regexp_extract_all({_FOLD.format(_NAME)}, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN '0' || lpad(p, 20, '0') ELSE '1' || p END), ''), relative_path, domain LIMIT 100")
def r_sorted_names(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred files by name as people sort."""
    return routing.sorted_names(table(spark, d, "file_profiles"), 100).select("profile_id")


@query("SELECT profile_id FROM file_profiles p WHERE domain = 'documents' AND format IN ('pdf', 'docx') AND state = 'analysed' AND document_date[1:4] IN ('2024', '2025') AND relative_path IN (SELECT relative_path FROM file_profile_entities WHERE type_id = 'person')")
def r_explorer(spark: SparkSession, d: str) -> DataFrame:
    """Files under all the explorer's filters, with people among them."""
    ticked = table(spark, d, "file_profile_entities").where("type_id = 'person'")
    return routing.explorer(table(spark, d, "file_profiles"), ["documents"], ["pdf", "docx"], ["analysed"], years=["2024", "2025"], ticked=ticked).select("profile_id")


@query(f"SELECT profile_id, CASE WHEN coalesce(starts_with(relative_path, 'laboratoire/') AND format = 'pdf', false) THEN 'analyse' WHEN coalesce(list_contains({_WORDS.format('title')}, 'decompte') AND list_contains({_WORDS.format('title')}, 'du'), false) THEN 'decompte date' WHEN coalesce(format = 'eml', false) THEN 'message' END AS user_type FROM file_profiles")
def r_user_types(spark: SparkSession, d: str) -> DataFrame:
    """Types by a user's own rules over stored profiles."""
    rules = '[{"type": "analyse", "path": "laboratoire", "format": "pdf"}, {"type": "decompte date", "words": ["Décompte", "du"]}, {"type": "message", "format": "eml"}]'
    return routing.user_types(table(spark, d, "file_profiles"), rules)


@query("SELECT \"column\", word, value FROM (" + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", unnest(list_distinct({_WORDS.format(c)})) AS word, {c} AS value FROM rendez_vous_lilas WHERE {c} IS NOT NULL" for c in ("motif", "caisse")) + ")")
def r_value_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the cells of two columns, that questions may name."""
    return routing.value_words(table(spark, d, "rendez_vous_lilas"), ["motif", "caisse"])


@query(f"SELECT row_id FROM patients_ch WHERE no_avs = (SELECT min(no_avs) FROM patients_ch WHERE no_avs LIKE '756.%') OR {_FOLD.format('trim(nom)')} = (SELECT min(no_avs) FROM patients_ch WHERE no_avs LIKE '756.%')")
def r_row_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold an identifier a question names, here the least insurance number."""
    p = table(spark, d, "patients_ch")
    token = p.where("no_avs like '756.%'").agg(F.min("no_avs")).first()[0] or ""
    return routing.row_lookup(p, token, ["no_avs", "nom"]).select("row_id")


@query(f"SELECT count(*) AS value FROM rendez_vous_lilas WHERE {_FOLD.format('motif')} = 'suivi'")
def r_plan_canonical(spark: SparkSession, d: str) -> DataFrame:
    """A plan whose value is matched to the column's own writings before it is run."""
    df = table(spark, d, "rendez_vous_lilas").select("motif", "caisse")
    sheet = describe(df)
    op = query_plan.parse('{"filters": [{"column": "motif", "op": "eq", "value": "SUIVI"}], "aggregate": {"op": "count"}}', sheet)
    filters = tuple(Filter(f.column, "in", tuple(routing.canonical(df, f.column, str(f.values[0])))) for f in op.filters)
    return execute(df, sheet, Operation("count", filters=filters))


@query(f"SELECT count(*) AS value FROM rendez_vous_lilas WHERE {_FOLD.format('motif')} = 'vaccination'")
def r_question_values(spark: SparkSession, d: str) -> DataFrame:
    """A question whose words are anchored on a column's real values."""
    df = table(spark, d, "rendez_vous_lilas").select("motif", "caisse")
    asked = "Combien de rendez-vous pour vaccination ?"
    words = F.array(*map(F.lit, routing._plain(asked).replace("?", " ").split()))
    index = routing.value_words(df, ["motif"])
    # only values all of whose words the question has may be meant; their number is bounded by the question's
    meant = index.groupBy("value").agg(F.collect_set("word").alias("ws")).where(F.size(F.array_except("ws", words)) == 0).select("value").orderBy("value").limit(300)
    route = classify(asked, describe(df), {"motif": [r["value"] for r in meant.collect()]})
    return execute(df, describe(df), route.operation)


@query(f"""WITH w AS (SELECT row_id, relative_path, {_WORDS.format('text')} AS w FROM ocr_page_cache WHERE text IS NOT NULL), s AS (SELECT row_id, relative_path, len(list_filter(w, lambda x: x = 'irm')) / len(w) AS score FROM w WHERE list_contains(w, 'irm')),
    n AS (SELECT * FROM s WHERE starts_with(relative_path, 'laboratoire/')), b AS (SELECT coalesce(max(score), -1) AS best FROM n) SELECT row_id FROM n, b WHERE best >= 0.65 UNION ALL SELECT row_id FROM s, b WHERE best < 0.65""")
def r_widened(spark: SparkSession, d: str) -> DataFrame:
    """A search in one folder that goes on to all, as nothing in it is near enough."""
    from lectern.functions.text import words_of

    w = words_of(F.col("text"))
    s = table(spark, d, "ocr_page_cache").where(F.array_contains(w, "irm")).select("row_id", "relative_path", (F.size(F.filter(w, lambda x: x == "irm")) / F.size(w)).alias("score"))
    return routing.widened(s.where(F.startswith("relative_path", F.lit("laboratoire/"))), s, "score").select("row_id")


@query(f"SELECT row_id FROM ocr_page_cache WHERE contains(' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ', ' cabinet medical des lilas ') OR contains(' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ', ' laboratoire de cachotet ')")
def r_entity_terms(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold any form of the entities a question names."""
    t = F.col("text")
    return table(spark, d, "ocr_page_cache").where(search.phrase(t, "Cabinet médical des Lilas") | search.phrase(t, "Laboratoire de Cachotet")).select("row_id")


@query("SELECT profile_id, concat_ws('|', domain, relative_path) AS key, concat_ws('|', domain, lower(relative_path)) AS folded FROM file_profiles")
def r_index_key(spark: SparkSession, d: str) -> DataFrame:
    """The key a file has in the index, by its family and path."""
    return table(spark, d, "file_profiles").select("profile_id", F.concat_ws("|", "domain", "relative_path").alias("key"), F.concat_ws("|", "domain", F.lower("relative_path")).alias("folded"))


@query("SELECT relative_path, coalesce(list_sort(list_distinct(list(surface) FILTER (type_id = 'person'))), []) AS people, coalesce(list_sort(list_distinct(list(type_id))), []) AS types, count(*) AS mentions FROM file_profile_entities WHERE relative_path IS NOT NULL GROUP BY 1")
def r_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each file: the people it names and the types among them. A file's names are as many as it links, and
    different ones are kept once."""
    e = table(spark, d, "file_profile_entities").where("relative_path is not null")
    return e.groupBy("relative_path").agg(F.array_sort(F.collect_set(F.when(F.col("type_id") == "person", F.col("surface")))).alias("people"), F.array_sort(F.collect_set("type_id")).alias("types"), F.count("*").alias("mentions"))


@query("SELECT relative_path, page_number, count(DISTINCT surface) AS names FROM ocr_page_cache o JOIN (SELECT DISTINCT relative_path, surface FROM file_profile_entities) e USING (relative_path) WHERE contains(o.text, e.surface) GROUP BY ALL")
def r_mentions_by_page(spark: SparkSession, d: str) -> DataFrame:
    """How many of a file's linked names each of its pages writes."""
    names = table(spark, d, "file_profile_entities").select("relative_path", "surface").distinct()
    pages = table(spark, d, "ocr_page_cache").select("relative_path", "page_number", "text")
    return pages.join(names, "relative_path").where(F.col("text").contains(F.col("surface"))).groupBy("relative_path", "page_number").agg(F.countDistinct("surface").alias("names"))


@query("SELECT facet, value, n FROM (SELECT 'year' AS facet, document_date[1:4] AS value, count(*) AS n FROM file_profiles WHERE document_date IS NOT NULL GROUP BY 2 UNION ALL SELECT 'type', business_type, count(*) FROM file_profiles WHERE business_type IS NOT NULL GROUP BY 2)")
def r_facet_order(spark: SparkSession, d: str) -> DataFrame:
    """Facets as shown: years newest first, others by count."""
    from lectern.operators.relational import facets

    found = facets(table(spark, d, "file_profiles").select(F.substring("document_date", 1, 4).alias("year"), F.col("business_type").alias("type")), ["year", "type"])
    return found.orderBy("facet", F.when(F.col("facet") == "year", -F.col("value").try_cast("int")).otherwise(-F.col("n")), "value")

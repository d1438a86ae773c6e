"""Queries of extraction: identifiers, dictionary matches, column semantics, values, aliases; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import words_of
from lectern.operators import extract, knowledge
from lectern.plans.base import _WORDS
from lectern.plans.catalog import query
from lectern.session import table

#: The practice's identifier schemes, their layouts, and what its headers mean, as a lexicon pack.
PACK = r"""{"schemes": {"avs": "\\b756[.]\\d{4}[.]\\d{4}[.]\\d{2}\\b", "dossier": "\\bLIL \\d{3}-\\d{4}\\b", "invoice": "\\b[A-Z]{2}-\\d{6}\\b", "reference": "\\b20\\d{2}/\\d{4,5}\\b"},
    "layouts": {"avs": [3, 4, 4, 2]}, "headers": {"person": ["patient", "nom", "medecin"], "amount": ["montant"]}, "relations": [["patient", "medecin", "treated_by"]]}"""
_PATTERNS = {"avs": r"\b756[.]\d{4}[.]\d{4}[.]\d{2}\b", "dossier": r"\bLIL \d{3}-\d{4}\b", "invoice": r"\b[A-Z]{2}-\d{6}\b", "reference": r"\b20\d{2}/\d{4,5}\b"}
_COMPACT = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
_SCAN = " UNION ".join(f"SELECT doc_id, '{s}' AS scheme, unnest(regexp_extract_all(text, '{p}')) AS written FROM documents" for s, p in _PATTERNS.items())
_NAMES = "(SELECT DISTINCT surface FROM file_profile_entities WHERE type_id IN ('person', 'organization'))"
_ENTRIES = f"SELECT DISTINCT array_to_string({_WORDS.format('surface')}, ' ') AS run FROM {_NAMES} WHERE len({_WORDS.format('surface')}) BETWEEN 1 AND 5"


def _long(table_name: str, key: str, column: str) -> str:
    """SQL of the longest dictionary entry at each place of a text."""
    return f"""WITH d AS ({_ENTRIES}), w AS (SELECT {key} AS k, {_WORDS.format(column)} AS ws FROM {table_name} WHERE {column} IS NOT NULL), p AS (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
        r AS (SELECT k, pos, unnest(range(1, least(5, len(ws) - pos + 1) + 1)) AS size, ws FROM p), h AS (SELECT k, pos, size, array_to_string(ws[pos:pos + size - 1], ' ') AS run FROM r),
        l AS (SELECT k, pos, max(size) AS size, max_by(run, size) AS run FROM h WHERE run IN (SELECT run FROM d) GROUP BY ALL) """


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return extract.dictionary(table(spark, d, "file_profile_entities").where(F.col("type_id").isin("person", "organization")).select("surface").distinct(), "surface")


@query(f"SELECT doc_id, scheme, written, {_COMPACT.format('written')} AS compact FROM ({_SCAN})")
def g_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the pack's schemes in all documents."""
    return extract.scan_identifiers(table(spark, d, "documents"), "doc_id", "text", extract.load_pack(PACK).schemes)


_FIELD_SCAN = " UNION ".join(f"SELECT row_id, '{s}' AS scheme, unnest(regexp_extract_all(value, '{p}')) AS written FROM file_profile_fields" for s, p in _PATTERNS.items())


@query(f"SELECT DISTINCT p.row_id, s.doc_id FROM ({_FIELD_SCAN}) p JOIN ({_SCAN}) s ON s.scheme = p.scheme AND {_COMPACT.format('s.written')} = {_COMPACT.format('p.written')}")
def g_identifier_join(spark: SparkSession, d: str) -> DataFrame:
    """Fields of profiles and the documents that write an identifier of the same scheme and value."""
    schemes = extract.load_pack(PACK).schemes
    found = extract.scan_identifiers(table(spark, d, "documents"), "doc_id", "text", schemes).select("doc_id", "scheme", "compact").distinct()
    fields = extract.scan_identifiers(table(spark, d, "file_profile_fields"), "row_id", "value", schemes).select("row_id", "scheme", "compact").distinct()
    return fields.join(found, ["scheme", "compact"]).select("row_id", "doc_id").distinct()


@query(f"SELECT row_id, CASE WHEN length(c) = 13 THEN c[1:3] || '.' || c[4:7] || '.' || c[8:11] || '.' || c[12:13] END AS written FROM (SELECT row_id, {_COMPACT.format('no_avs')} AS c FROM patients_ch)")
def g_identifier_layout(spark: SparkSession, d: str) -> DataFrame:
    """Insurance numbers in the groups they are written in."""
    compact = F.upper(F.regexp_replace("no_avs", "[^A-Za-z0-9]", ""))
    return table(spark, d, "patients_ch").select("row_id", extract.grouped(compact, extract.load_pack(PACK).layouts["avs"]).alias("written"))


@query(f"SELECT DISTINCT unnest(CASE WHEN length(c) = 13 THEN [c] || list_transform(['.', ' ', '-'], lambda s: c[1:3] || s || c[4:7] || s || c[8:11] || s || c[12:13]) ELSE [c] END) AS form FROM (SELECT {_COMPACT.format('no_avs')} AS c FROM patients_ch WHERE no_avs IS NOT NULL)")
def g_identifier_forms(spark: SparkSession, d: str) -> DataFrame:
    """All ways the insurance numbers may be written in a question."""
    compact = F.upper(F.regexp_replace("no_avs", "[^A-Za-z0-9]", ""))
    return table(spark, d, "patients_ch").where("no_avs is not null").select(F.explode(extract.identifier_forms(compact, [3, 4, 4, 2])).alias("form")).distinct()


@query(_long("documents", "doc_id", "text") + "SELECT k AS doc_id, pos AS \"at\", size, run FROM l")
def g_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """Known names in all documents, the longest at each place."""
    return extract.longest_matches(table(spark, d, "documents"), "doc_id", "text", _entries(spark, d))


@query(_long("file_profile_fields", "row_id", "value") + "SELECT k AS row_id, run FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.k = l.k AND o.pos < l.pos + l.size AND o.pos + o.size > l.pos AND (o.size > l.size OR (o.size = l.size AND o.pos < l.pos)))")
def g_names_asked(spark: SparkSession, d: str) -> DataFrame:
    """Known names in short texts, here all values of profiles: longest runs first, none overlapping."""
    f = table(spark, d, "file_profile_fields")
    return extract.apart(extract.longest_matches(f, "row_id", "value", _entries(spark, d)), "row_id").select("row_id", "run")


@query()
def g_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every known name under a mark."""
    return extract.strip_known(table(spark, d, "documents"), "doc_id", "text", _entries(spark, d))


_PERSON = r"^(?:(?:Dr|Dre|Mme|M\.|Prof\.)\s+)?\p{Lu}[\p{L}''’-]+(?:\s+\p{Lu}[\p{L}''’-]+){1,2}$"
_COLS = ["date_rdv", "patient", "medecin", "motif", "montant", "caisse"]
_SHAPES = (
    "WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim({c}) AS v FROM rendez_vous_lilas WHERE trim({c}) <> ''" for c in _COLS) + "), "
    f"h AS (SELECT \"column\", count(*) AS filled, avg(CAST(regexp_matches(v, '{_PERSON}') AS DOUBLE)) AS person, "
    r"avg(CAST(length(regexp_replace(v, '\D', '', 'g')) > 0 AND length(regexp_replace(v, '\P{L}', '', 'g')) * 3 <= length(v) AND NOT regexp_matches(v, '^\d{1,2}[./-]\d{1,2}[./-]\d{4}$|^\d{4}-\d{2}-\d{2}$') AS DOUBLE)) AS identifier, "
    r"avg(CAST(length(v) > 40 OR len(string_split_regex(v, '\s+')) > 5 AS DOUBLE)) AS text FROM s GROUP BY 1) "
)


@query(_SHAPES + 'SELECT "column", filled, round(person, 6) AS person, round(identifier, 6) AS identifier, round(text, 6) AS text FROM h')
def g_value_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shares of shapes among the cells of the appointments' columns."""
    return extract.value_shapes(table(spark, d, "rendez_vous_lilas"), _COLS).select("column", "filled", *[F.round(c, 6).alias(c) for c in ("person", "identifier", "text")])


@query(_SHAPES + """SELECT "column", CASE WHEN "column" IN ('patient', 'medecin') AND person >= 0.7 THEN 'person' WHEN "column" = 'caisse' AND text < 0.7 THEN 'organization' WHEN "column" = 'date_rdv' THEN 'date' WHEN "column" = 'montant' THEN 'amount'
    WHEN text >= 0.7 THEN 'text' WHEN "column" NOT IN ('patient', 'medecin', 'caisse') AND filled >= 5 AND person >= 0.9 THEN 'person' ELSE 'other' END AS semantics FROM h""")
def g_column_semantics(spark: SparkSession, d: str) -> DataFrame:
    """What the appointments' columns hold."""
    return extract.column_semantics(extract.value_shapes(table(spark, d, "rendez_vous_lilas"), _COLS))


@query("SELECT trim(caisse) AS value, count(*) AS n, list_sort(list(row_id))[1:3] AS rows FROM rendez_vous_lilas WHERE trim(caisse) <> '' GROUP BY 1")
def g_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of a column with the first rows that hold each."""
    return extract.distinct_values(table(spark, d, "rendez_vous_lilas"), "caisse", "row_id")


@query("SELECT trim(prenom) || ' ' || trim(nom) AS person, count(*) AS n FROM patients_ch WHERE trim(prenom) <> '' AND trim(nom) <> '' GROUP BY 1")
def g_name_parts(spark: SparkSession, d: str) -> DataFrame:
    """Persons from the columns of their given and family names."""
    return extract.name_parts(table(spark, d, "patients_ch"), "prenom", "nom")


@query(f"SELECT trim(prenom) || ' ' || trim(nom) AS person, {_COMPACT.format('no_avs')} AS identifier, count(*) AS n FROM patients_ch WHERE prenom IS NOT NULL AND nom IS NOT NULL AND {_COMPACT.format('no_avs')} <> '' GROUP BY ALL")
def g_attached(spark: SparkSession, d: str) -> DataFrame:
    """Insurance numbers of the persons in whose rows they stand."""
    p = table(spark, d, "patients_ch")
    return extract.attach_identifiers(p, [F.when(F.col("prenom").isNotNull() & F.col("nom").isNotNull(), F.concat_ws(" ", F.trim("prenom"), F.trim("nom")))], "no_avs")


@query("SELECT patient AS subject, medecin AS object, 'treated_by' AS predicate, count(*) AS n, min(least(CASE WHEN length(patient) > 12 THEN 0.9 ELSE 0.7 END, CASE WHEN starts_with(medecin, 'Dr') THEN 0.8 ELSE 0.6 END)) AS confidence FROM rendez_vous_lilas WHERE patient IS NOT NULL AND medecin IS NOT NULL GROUP BY ALL")
def g_relations(spark: SparkSession, d: str) -> DataFrame:
    """Patients and doctors that rows put together, as sure as the less sure side."""
    (subject, obj, predicate), *_ = extract.load_pack(PACK).relations
    rows = table(spark, d, "rendez_vous_lilas").withColumn("s", F.when(F.length("patient") > 12, 0.9).otherwise(0.7)).withColumn("o", F.when(F.startswith("medecin", F.lit("Dr")), 0.8).otherwise(0.6))
    return knowledge.relations(rows, subject, obj, predicate, ["s", "o"])


@query(r"""WITH n AS (SELECT DISTINCT surface AS name, regexp_extract(surface, '^(\S+)\s+(\S+)$', 1) AS g, regexp_extract(surface, '^(\S+)\s+(\S+)$', 2) AS s FROM file_profile_entities WHERE type_id = 'person'),
    f AS (SELECT name, unnest([{'k': 'swapped', 'a': s || ' ' || g}, {'k': 'comma', 'a': s || ', ' || g}, {'k': 'initial', 'a': g[1] || '. ' || s}, {'k': 'surname_initial', 'a': s || ' ' || g[1] || '.'}, {'k': 'capitals', 'a': upper(s) || ' ' || g}, {'k': 'folded', 'a': lower(strip_accents(g || ' ' || s))}]) AS x FROM n WHERE g <> '' AND s <> '')
    SELECT DISTINCT name, x.k AS kind, x.a AS alias FROM f WHERE x.a <> name""")
def g_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Forms the names of persons may also be written in."""
    return extract.aliases(table(spark, d, "file_profile_entities").where("type_id = 'person'").select("surface").distinct(), "surface")


@query(r"""WITH w AS (SELECT profile_id, """ + _WORDS.format(r"regexp_replace(regexp_extract(relative_path, '([^/]*?)(?:\.[^./]*)?$', 1), '\d+', ' ', 'g')") + """ AS ws FROM file_profiles), p AS (SELECT profile_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w), r AS (SELECT profile_id, ws, pos, unnest(range(1, least(3, len(ws) - pos + 1) + 1)) AS size FROM p)
    SELECT DISTINCT profile_id, array_to_string(ws[pos:pos + size - 1], ' ') AS run FROM r""")
def g_filename_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words in file names that may be names."""
    return extract.filename_candidates(table(spark, d, "file_profiles"), "profile_id", "relative_path")


@query(r"""SELECT DISTINCT surface, CASE WHEN regexp_matches(surface, '^\p{Lu}[\p{L}''’-]+,?\s+(?:\p{Lu}\.[- ]?)+$') THEN 'surname_initial' WHEN regexp_matches(surface, '^(?:\p{Lu}\.[- ]?)+\s*\p{Lu}[\p{L}''’-]+$') THEN 'initial_surname'
    WHEN regexp_matches(surface, '^\p{Lu}[\p{L}''’-]+,\s*\p{Lu}[\p{L}''’-]+$') OR (regexp_matches(surface, '^[\p{Lu}''’-]{2,}\s+\p{Lu}[\p{L}''’-]+$') AND NOT regexp_matches(surface, '^[\p{Lu}''’-]+\s+[\p{Lu}''’-]+$')) THEN 'surname_first'
    WHEN regexp_matches(surface, '^\p{Lu}[\p{L}''’-]+\s+\p{Lu}[\p{L}''’-]+$') THEN 'given_first' END AS "order" FROM file_profile_entities WHERE type_id = 'person'""")
def g_name_order(spark: SparkSession, d: str) -> DataFrame:
    """How the names of persons are written."""
    return table(spark, d, "file_profile_entities").where("type_id = 'person'").select("surface", extract.name_order(F.col("surface")).alias("order")).distinct()


@query(f"SELECT DISTINCT unnest({_WORDS.format('value')}) AS word FROM file_profile_fields WHERE kind = 'column_header'")
def g_header_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of all column headers."""
    return table(spark, d, "file_profile_fields").where("kind = 'column_header'").select(F.explode(words_of(F.col("value"))).alias("word")).distinct()


_TITLES = "['m','mme','mlle','monsieur','madame','dr','dre','docteur','prof','me','herr','frau','mr','mrs','ms']"


@query(f"SELECT DISTINCT surface, array_to_string(list_filter({_WORDS.format('surface')}, lambda x: NOT list_contains({_TITLES}, x)), ' ') AS key FROM file_profile_entities WHERE surface IS NOT NULL")
def g_name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names as the words that count, without forms of address."""
    return table(spark, d, "file_profile_entities").where("surface is not null").select("surface", knowledge.name_key(F.col("surface")).alias("key")).distinct()


@query(f"""WITH t AS (SELECT row_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS h FROM ocr_page_cache WHERE text IS NOT NULL), v AS (SELECT DISTINCT commune AS value, array_to_string({_WORDS.format('commune')}, ' ') AS w FROM patients_ch WHERE len({_WORDS.format('commune')}) BETWEEN 1 AND 5),
    x AS (SELECT row_id, value, w FROM t JOIN v ON contains(t.h, ' ' || v.w || ' ')) SELECT row_id, CASE WHEN count(DISTINCT w) = 1 THEN min(value) END AS value, count(DISTINCT w) AS n FROM x GROUP BY 1""")
def g_table_link(spark: SparkSession, d: str) -> DataFrame:
    """The one value of a column that a page writes whole; several make no link."""
    values = table(spark, d, "patients_ch").select(F.col("commune").alias("value"), F.array_join(words_of(F.col("commune")), " ").alias("run")).where("run <> ''").distinct()
    hits = extract.runs(table(spark, d, "ocr_page_cache"), "row_id", "text").join(values, "run")
    return hits.groupBy("row_id").agg(F.when(F.countDistinct("run") == 1, F.min("value")).alias("value"), F.countDistinct("run").alias("n"))


@query()
def g_document_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and identifiers of all documents by their surest source."""
    return extract.document_names(table(spark, d, "documents"), "doc_id", "text", _entries(spark, d), extract.load_pack(PACK).schemes)


@query("SELECT doc_id, 'identifier' AS source, count(*) AS n FROM (SELECT DISTINCT doc_id, written FROM (" + _SCAN + ")) GROUP BY ALL")
def g_identifier_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many different identifiers each document writes."""
    found = extract.scan_identifiers(table(spark, d, "documents"), "doc_id", "text", extract.load_pack(PACK).schemes)
    return found.select("doc_id", "written").distinct().groupBy("doc_id", F.lit("identifier").alias("source")).agg(F.count("*").alias("n"))

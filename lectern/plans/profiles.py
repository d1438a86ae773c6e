"""Queries of profiles, cards, resolution and the base's changes, with their SQL; and SQL of queries registered elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.numbers import MONTHS
from lectern.functions.spoken import digits_one_by_one, spoken_form
from lectern.functions.text import words_of
from lectern.operators import knowledge, pipeline, profiles, search
from lectern.plans.base import _WORDS
from lectern.plans.catalog import SQL, query
from lectern.plans.extraction import _TITLES
from lectern.session import spread, table

_KEY = f"array_to_string(list_filter({_WORDS}, lambda x: NOT list_contains({_TITLES}, x)), ' ')"
_SET = f"array_to_string(list_sort(list_filter({_WORDS}, lambda x: NOT list_contains({_TITLES}, x))), ' ')"


def _date(c: str) -> str:
    """SQL of a cell's calendar date, ISO or day first."""
    return rf"TRY_CAST(CASE WHEN regexp_full_match(trim({c}), '\d{{4}}-\d\d-\d\d') THEN trim({c}) WHEN regexp_full_match(trim({c}), '\d\d?[/.-]\d\d?[/.-]\d{{4}}') THEN regexp_extract(trim({c}), '(\d{{4}})$', 1) || '-' || lpad(regexp_extract(trim({c}), '^\d\d?[/.-](\d\d?)', 1), 2, '0') || '-' || lpad(regexp_extract(trim({c}), '^(\d\d?)', 1), 2, '0') END AS DATE)"


@query("SELECT domain, relative_path, detail, value, source FROM (SELECT *, row_number() OVER (PARTITION BY domain, relative_path, detail ORDER BY confidence DESC NULLS LAST, recorded_at DESC NULLS LAST, row_id) AS r FROM file_profile_fields WHERE kind = 'metadata' AND detail IN ('title', 'author', 'subject') AND trim(value) <> '') WHERE r = 1")
def c_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Title, author and subject of each file, with their evidence."""
    return profiles.chosen_fields(table(spark, d, "file_profile_fields"), ["title", "author", "subject"])


@query(r"""WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split_regex(text, '\r?\n')[1:12] AS ls FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, line, lower(strip_accents(regexp_extract(t, '^\s*([\p{L}][\p{L} .''’-]{1,30}?)\s*:\s+(\S.*)$', 1))) AS label, trim(regexp_extract(t, '^\s*([\p{L}][\p{L} .''’-]{1,30}?)\s*:\s+(\S.*)$', 2)) AS value FROM l WHERE regexp_matches(t, '^\s*([\p{L}][\p{L} .''’-]{1,30}?)\s*:\s+(\S.*)$')""")
def c_header_lines(spark: SparkSession, d: str) -> DataFrame:
    """Labelled lines at the head of all documents."""
    return profiles.header_lines(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH e AS (SELECT domain, relative_path, CASE detail WHEN 'created' THEN 0 ELSE 1 END AS rank, {_date('value')} AS d FROM file_profile_fields WHERE kind = 'metadata' AND detail IN ('created', 'modified')), b AS (SELECT domain, relative_path, min(rank) AS rank FROM e WHERE d IS NOT NULL GROUP BY ALL) SELECT domain, relative_path, rank, CAST(CASE WHEN count(DISTINCT d) = 1 THEN min(d) END AS VARCHAR) AS date FROM e JOIN b USING (domain, relative_path, rank) WHERE d IS NOT NULL GROUP BY ALL")
def c_date_choice(spark: SparkSession, d: str) -> DataFrame:
    """The date of each file its best evidence agrees on."""
    rows = table(spark, d, "file_profile_fields").where((F.col("kind") == "metadata") & F.col("detail").isin("created", "modified")).withColumn("rank", F.when(F.col("detail") == "created", 0).otherwise(1))
    return profiles.date_of_evidence(rows, ["domain", "relative_path"], "rank", "value").withColumn("date", F.col("date").cast("string"))


_COLUMNS = ["date_rdv", "motif", "caisse"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS filled, (SELECT count(DISTINCT w) FROM (SELECT unnest({_WORDS.format(c)}) AS w FROM rendez_vous_lilas WHERE trim({c}) <> '')) AS words, CAST(min({_date(c)}) AS VARCHAR) AS first_date, CAST(max({_date(c)}) AS VARCHAR) AS last_date FROM rendez_vous_lilas WHERE trim({c}) <> ''" for c in _COLUMNS))
def c_column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Words and dates of columns."""
    out = profiles.column_profile(table(spark, d, "rendez_vous_lilas"), _COLUMNS)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


_CARDS = r"""WITH g AS (SELECT relative_path, page_number, CASE WHEN regexp_extract(text, '(?s)^\s*(.+?[.!?…])(?:\s|$)', 1) <> '' THEN regexp_extract(text, '(?s)^\s*(.+?[.!?…])(?:\s|$)', 1) ELSE substring(trim(text), 1, 200) END AS d FROM ocr_page_cache WHERE length(trim(text)) > 0),
    c AS (SELECT relative_path, substring(string_agg(d, ' ' ORDER BY page_number, d), 1, 12000) AS card FROM g GROUP BY 1) """
SQL["c_cards"] = _CARDS + "SELECT relative_path, card FROM c"


@query(_CARDS + f", r AS (SELECT relative_path, len(ws) AS n, len(list_filter(ws, lambda x: x = 'facture')) AS a FROM (SELECT relative_path, {_WORDS.format('card')} AS ws FROM c) WHERE len(ws) > 0), s AS (SELECT count(*) AS docs, avg(n) AS m, count(*) FILTER (a > 0) AS df FROM r) SELECT relative_path, round(CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * r.n / m)), 4) AS score FROM r, s WHERE a > 0")
def q_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of scanned files by a word."""
    cards = pipeline.cards(table(spark, d, "ocr_page_cache"), "relative_path", "page_number", "text")
    return search.bm25(cards, "relative_path", "card", ["facture"]).withColumn("score", F.round("score", 4))


SQL["q_best_passage"] = f"""WITH r AS (SELECT row_id, relative_path, page_number, len(ws) AS n, len(list_filter(ws, lambda x: x = 'cardiologie')) AS a FROM (SELECT row_id, relative_path, page_number, {_WORDS.format("coalesce(text, '')")} AS ws FROM ocr_page_cache)),
    s AS (SELECT count(*) AS docs, avg(n) AS m, count(*) FILTER (a > 0) AS df FROM r WHERE n > 0), x AS (SELECT row_id, relative_path, page_number, CASE WHEN a > 0 THEN CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * r.n / m)) END AS score FROM r, s)
    SELECT relative_path, CASE WHEN max(score) IS NULL THEN min_by(row_id, (page_number, row_id)) ELSE min_by(row_id, (-coalesce(score, -1), row_id)) END AS row_id, round(coalesce(max(score), 0), 4) AS score FROM x GROUP BY 1"""
SQL["c_repeated_lines"] = r"""WITH p AS (SELECT relative_path, page_number, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM ocr_page_cache), e AS (SELECT relative_path, page_number, unnest(l[1:2] || l[greatest(1, len(l) - 1):len(l)]) AS line FROM p),
    k AS (SELECT relative_path, trim(lower(regexp_replace(line, '\d+', '#', 'g'))) AS key, count(DISTINCT page_number) AS pages FROM e WHERE length(line) <= 100 AND len(regexp_extract_all(line, '\d+')) <= 3 GROUP BY ALL),
    o AS (SELECT relative_path, count(DISTINCT page_number) AS n FROM ocr_page_cache WHERE length(trim(text)) > 0 GROUP BY 1) SELECT relative_path, key, pages FROM k JOIN o USING (relative_path) WHERE n >= 4 AND pages * 2 >= n"""
SQL["f_excerpt"] = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), p AS (SELECT doc_id, ws, list_position(list_transform(ws, lambda x: starts_with(regexp_replace(lower(strip_accents(x)), '[^\p{L}\p{N}]+', '', 'g'), 'scanner')), true) AS k FROM w)
    SELECT doc_id, array_to_string(ws[greatest(1, k - 8):greatest(1, k - 8) + 27], ' ') AS excerpt FROM p WHERE k > 0"""
SQL["e_entities"] = f"""WITH r AS (SELECT *, {_KEY.format('surface')} AS key FROM file_profile_entities WHERE surface IS NOT NULL), w AS (SELECT key, surface, count(*) AS n FROM r WHERE key <> '' GROUP BY ALL), nm AS (SELECT key, min_by(surface, (-n, surface)) AS name FROM w GROUP BY 1)
    SELECT nm.key, nm.name, count(*) AS mentions, count(DISTINCT (domain, relative_path)) AS files, max(confidence) AS confidence, max(type_id) AS type_id, CASE WHEN count(DISTINCT (domain, relative_path)) >= 2 THEN 'active' ELSE 'candidate' END AS status FROM nm JOIN r ON nm.key = r.key GROUP BY ALL"""


_INITIALS = r"CASE WHEN len({w}) = 2 THEN [{w}[2] || ' ' || {w}[1][1:1], {w}[1] || ' ' || {w}[2][1:1]] END"


@query(f"""WITH b AS (SELECT DISTINCT CAST(entity_id AS BIGINT) AS id, surface AS name FROM file_profile_entities WHERE entity_id IS NOT NULL AND type_id = 'person'), q AS (SELECT DISTINCT surface AS name FROM file_profile_entities WHERE entity_id IS NULL AND surface IS NOT NULL),
    c AS (SELECT id, name, {_KEY.format('name')} AS k, {_SET.format('name')} AS t FROM b), k AS (SELECT name, {_KEY.format('name')} AS k, {_SET.format('name')} AS t FROM q),
    h AS (SELECT k.name, NULL::BIGINT AS id, 0 AS s FROM k WHERE k.k IN (SELECT {_KEY.format('surface')} FROM file_profile_entities WHERE type_id = 'location')
        UNION ALL SELECT k.name, c.id, 1 FROM k JOIN c USING (k) UNION ALL SELECT k.name, a.id, 2 FROM k JOIN (SELECT DISTINCT id, k FROM (SELECT id, {_KEY.format("regexp_replace(name, '^(\\S+)\\s+(\\S+)$', '\\2 \\1')")} AS k FROM b WHERE regexp_full_match(name, '\\S+\\s+\\S+'))) a USING (k)
        UNION ALL SELECT k.name, c.id, 3 FROM k JOIN c USING (t)
        UNION ALL SELECT x.name, y.id, 4 FROM (SELECT name, unnest({_INITIALS.format(w=_WORDS.format('name'))}) AS i FROM q WHERE regexp_matches(name, '(^|\\s)\\p{{Lu}}\\.(\\s|$)')) x JOIN (SELECT id, unnest({_INITIALS.format(w=_WORDS.format('name'))}) AS i FROM b) y USING (i)
        UNION ALL SELECT k.name, y.id, 5 FROM k JOIN (SELECT id, unnest(string_split(k, ' ')) AS k FROM c WHERE contains(k, ' ')) y USING (k) WHERE NOT contains(k.k, ' ') AND k.k <> ''),
    m AS (SELECT name, min(s) AS s FROM h GROUP BY 1), n AS (SELECT name, s, count(DISTINCT id) AS n, min(id) AS id FROM h JOIN m USING (name, s) GROUP BY ALL)
    SELECT q.name, CASE WHEN n = 1 THEN id END AS id, coalesce(['suppressed', 'canonical', 'alias', 'swapped', 'initial', 'surname'][s + 1], 'none') AS signal, CASE WHEN s = 0 THEN 'suppressed' WHEN n > 1 THEN 'ambiguous' WHEN s <= 2 THEN 'resolved' WHEN n = 1 THEN 'possible' ELSE 'unknown' END AS outcome FROM q LEFT JOIN n USING (name)""")
def e_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every unlinked name put through the cascade against the linked persons, places suppressed; without the fuzzy signal."""
    e = table(spark, d, "file_profile_entities")
    base = e.where("entity_id is not null and type_id = 'person'").select(F.col("entity_id").cast("bigint").alias("id"), F.col("surface").alias("name")).distinct()
    aliases = base.where(F.col("name").rlike(r"^\S+\s+\S+$")).select("id", F.regexp_replace("name", r"^(\S+)\s+(\S+)$", "$2 $1").alias("alias"))
    return profiles.resolve_cascade(e.where("entity_id is null").select(F.col("surface").alias("name")), base, aliases, e.where("type_id = 'location'").select(F.col("surface").alias("name")), fuzzy=False)


@query()
def e_cascade_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The cascade with all its signals."""
    e = table(spark, d, "file_profile_entities")
    base = e.where("entity_id is not null").select(F.col("entity_id").cast("bigint").alias("id"), F.col("surface").alias("name")).distinct()
    none = base.where("id < 0")
    return profiles.resolve_cascade(e.where("entity_id is null").select(F.col("surface").alias("name")), base, none.withColumnRenamed("name", "alias"), none.select("name"))


@query("SELECT row_id FROM file_profile_entities WHERE source IS DISTINCT FROM 'cells' UNION ALL SELECT -row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY domain, relative_path, surface, locator ORDER BY confidence DESC NULLS LAST, -row_id) AS r FROM file_profile_entities WHERE source = 'cells' AND confidence > 0.7) WHERE r = 1")
def e_delta(spark: SparkSession, d: str) -> DataFrame:
    """The mentions after a source was read anew, here the sure ones of the cells."""
    e = table(spark, d, "file_profile_entities")
    new = e.where("source = 'cells' and confidence > 0.7").withColumn("row_id", -F.col("row_id"))
    return profiles.apply_delta(e, new, "cells").select("row_id")


@query("WITH l AS (SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'unmerge' ELSE 'note' END AS kind, user_id AS id, event_id % 50 AS into_ FROM events), x AS (SELECT id, max_by(kind, seq) AS kind, max_by(into_, seq) AS into_ FROM l WHERE kind <> 'note' GROUP BY 1) SELECT id, CASE WHEN kind = 'merge' THEN into_ END AS merged_into FROM x")
def e_replay(spark: SparkSession, d: str) -> DataFrame:
    """Merges in force after a log of merges and their undoing."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "merge").when(n % 3 == 1, "unmerge").otherwise("note")
    return knowledge.replay(table(spark, d, "events").select(n.alias("seq"), kind.alias("kind"), F.col("user_id").alias("id"), (n % 50).alias("into")))


@query("SELECT 'Combien de lignes avec ' || \"column\" || ' = ' || value || ' ?' AS question, weight FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY weight DESC, value) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim({c}) AS value, count(*) AS weight FROM rendez_vous_lilas WHERE trim({c}) <> '' GROUP BY 2" for c in ("motif", "caisse", "medecin")) + ")) WHERE r <= 3")
def e_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Questions the appointments can answer."""
    return profiles.suggestions(table(spark, d, "rendez_vous_lilas"), ["motif", "caisse", "medecin"])



@query("SELECT row_id, array_to_string(list_transform(regexp_extract_all(no_avs, '\\d'), lambda c: ['zéro', 'un', 'deux', 'trois', 'quatre', 'cinq', 'six', 'sept', 'huit', 'neuf'][CAST(c AS INT) + 1]), ' ') AS said FROM patients_ch WHERE no_avs IS NOT NULL")
def f_digits(spark: SparkSession, d: str) -> DataFrame:
    """Insurance numbers said digit by digit."""
    return table(spark, d, "patients_ch").where("no_avs is not null").select("row_id", digits_one_by_one(F.col("no_avs")).alias("said"))


@query()
def f_spoken(spark: SparkSession, d: str) -> DataFrame:
    """All documents as they are spoken."""
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", F.when(F.col("lang") == "en", spoken_form(F.col("text"), "en")).otherwise(spoken_form(F.col("text"), "fr")).alias("said"))


@query()
def e_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Words of names no linked name has, with words of linked names that sound alike: what a dictation may have meant."""
    e = table(spark, d, "file_profile_entities")
    words = lambda df: df.select(F.explode(words_of(F.col("surface"))).alias("w")).where(F.length("w") >= 4).distinct()
    return profiles.sound_alikes(words(e.where("entity_id is null")), words(e.where("entity_id is not null")), "w")


_MONTHS = ", ".join(f"('{name}', '{n:02d}')" for n, names in MONTHS.items() for name in dict.fromkeys(names.split()))
_WRITTEN = rf"\b(\d{{1,2}})(?:er|\.)?\s+({'|'.join(' '.join(MONTHS.values()).split())})\s+(\d{{4}})\b"
SQL["f_dates_in_text"] = rf"""WITH m AS (SELECT * FROM (VALUES {_MONTHS}) AS t(name, nn)), f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{4}}\b')) AS x FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '{_WRITTEN}')) AS x FROM documents)
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1)) AS date FROM documents UNION SELECT doc_id, strftime({_date('x')}, '%Y-%m-%d') FROM f WHERE {_date('x')} IS NOT NULL
    UNION SELECT doc_id, regexp_extract(x, '{_WRITTEN}', 3) || '-' || nn || '-' || lpad(regexp_extract(x, '{_WRITTEN}', 1), 2, '0') FROM w JOIN m ON m.name = regexp_extract(x, '{_WRITTEN}', 2)"""
_REPEATED = SQL["c_repeated_lines"]
SQL["c_cleaned"] = (
    _REPEATED[: _REPEATED.rindex("SELECT relative_path, key, pages")]
    + r""", r AS (SELECT relative_path, list(key) AS keys FROM k JOIN o USING (relative_path) WHERE n >= 4 AND pages * 2 >= n GROUP BY 1), x AS (SELECT row_id, text, coalesce(keys, []) AS keys FROM ocr_page_cache LEFT JOIN r USING (relative_path))
    SELECT row_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: (trim(l) = '' OR regexp_matches(l, '[\p{L}\p{N}]')) AND NOT list_contains(keys, trim(lower(regexp_replace(l, '\d+', '#', 'g'))))), chr(10)), '(\p{L})[-¬­]\n(\p{Ll})', '\1\2', 'g') AS text FROM x"""
)


@query("SELECT name, id FROM (" + SQL["e_cascade"] + ") WHERE outcome = 'possible'")
def b_possible_partners(spark: SparkSession, d: str) -> DataFrame:
    """Open matches: names that only possibly are an entity, with it."""
    return e_cascade(spark, d).where("outcome = 'possible'").select("name", "id")

"""Queries of the entity base, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import base, knowledge
from lectern.operators.relational import best_per
from lectern.plans.catalog import query
from lectern.session import table

_FOLD = "lower(strip_accents({}))"
_WORDS = "list_filter(string_split_regex(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
#: Linked mentions, names, merged entities and effective mentions, as SQL.
_KB = f"""WITH m AS (SELECT * REPLACE (CAST(entity_id AS BIGINT) AS entity_id) FROM file_profile_entities WHERE entity_id IS NOT NULL),
    w AS (SELECT entity_id AS id, surface, count(*) AS n FROM m WHERE surface IS NOT NULL GROUP BY ALL),
    nm AS (SELECT id, surface AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, surface) AS r FROM w) WHERE r = 1),
    red AS (SELECT id, name, min(id) OVER (PARTITION BY {_FOLD.format('name')}) AS root FROM nm),
    sur AS (SELECT a.id, a.name, a.root, b.name AS root_name FROM red a JOIN nm b ON a.root = b.id),
    em AS (SELECT m.* EXCLUDE (entity_id), sur.root AS entity_id, sur.root_name AS name FROM m JOIN sur ON m.entity_id = sur.id) """


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_profile_entities")


@query(_KB + f"SELECT entity_id, name, count(*) AS mentions FROM em WHERE len(list_filter({_WORDS.format('surface')}, lambda x: starts_with(x, 'cl'))) > 0 GROUP BY ALL ORDER BY mentions DESC, name, entity_id LIMIT 20")
def b_prefix_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the start of a word of any writing, through merges, each once."""
    return base.prefix_search(_entities(spark, d), "Cl")


@query(_KB + "SELECT s.root AS entity_id, s.root_name AS name, coalesce(n, 0) AS mentions, coalesce(f, 0) AS files FROM (SELECT DISTINCT root, root_name FROM sur) s LEFT JOIN (SELECT entity_id, count(*) AS n, count(DISTINCT (domain, relative_path)) AS f FROM em WHERE domain = 'data' GROUP BY 1) x ON s.root = x.entity_id")
def b_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all entities within the tables."""
    return base.weights(_entities(spark, d), F.col("domain") == "data")


@query("SELECT e.row_id, CAST(e.entity_id AS BIGINT) AS entity_id, e.surface, p.title, p.business_type FROM file_profile_entities e LEFT JOIN file_profiles p ON e.domain = p.domain AND e.relative_path = p.relative_path WHERE e.entity_id IS NOT NULL")
def b_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with what their file is called, if anything."""
    return base.provenance(_entities(spark, d), table(spark, d, "file_profiles"))


@query(_KB + "SELECT entity_id, role, coalesce(list_position(['subject', 'issuer', 'recipient', 'mentioned'], role), 0) AS position, count(*) AS n FROM em WHERE role IS NOT NULL GROUP BY ALL")
def b_roles(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of entities by role."""
    return base.roles(_entities(spark, d))


@query("SELECT relative_path, regexp_extract(locator, '^cells:([^!]*)!(.*)$', 1) AS sheet, regexp_extract(locator, '^cells:([^!]*)!(.*)$', 2) AS \"column\", count(DISTINCT entity_id) AS entities, count(*) AS mentions FROM file_profile_entities WHERE entity_id IS NOT NULL AND starts_with(locator, 'cells:') GROUP BY ALL")
def b_table_places(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by file, sheet and column."""
    return base.table_places(_entities(spark, d))


@query(_KB + "SELECT entity_id, count(DISTINCT (domain, relative_path)) AS sources, CASE WHEN count(DISTINCT (domain, relative_path)) >= 2 THEN 'active' ELSE 'candidate' END AS status FROM em GROUP BY 1")
def b_supporting_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources behind each entity, merged ones included."""
    return base.supporting_sources(_entities(spark, d))


@query(_KB + f", k AS (SELECT DISTINCT entity_id, {_FOLD.format('name')} AS key FROM em), u AS (SELECT entity_id, domain, relative_path FROM em UNION SELECT k.entity_id, f.domain, f.relative_path FROM file_profile_fields f JOIN k ON {_FOLD.format('f.value')} = k.key WHERE f.kind = 'role_surface') SELECT entity_id, count(*) AS files FROM u GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10")
def b_entity_facet(spark: SparkSession, d: str) -> DataFrame:
    """The entities of most files, over mentions and profile fields."""
    return base.facet(_entities(spark, d), table(spark, d, "file_profile_fields"))


@query(_KB + """, p AS (SELECT entity_id, count(DISTINCT (domain, relative_path)) AS files, count(*) FILTER (domain = 'data') AS t, count(*) FILTER (domain = 'documents') AS o, count(type_id) AS typed, max(confidence) AS sure FROM em GROUP BY 1)
    SELECT 'candidates' AS list, count(*) FILTER (files < 2) AS n FROM p UNION ALL SELECT 'only_in_documents', count(*) FILTER (o > 0 AND t = 0) FROM p UNION ALL SELECT 'only_in_tables', count(*) FILTER (t > 0 AND o = 0) FROM p
    UNION ALL SELECT 'without_type', count(*) FILTER (typed = 0) FROM p UNION ALL SELECT 'unsure', count(*) FILTER (coalesce(sure, 0) < 0.5) FROM p
    UNION ALL SELECT 'files_without_entity', count(*) FROM file_profiles f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.domain = f.domain AND m.relative_path = f.relative_path)""")
def b_health(spark: SparkSession, d: str) -> DataFrame:
    """What in the base wants attention."""
    return base.health(_entities(spark, d), table(spark, d, "file_profiles"))


@query(_KB + "SELECT (SELECT count(DISTINCT root) FROM sur) AS entities, (SELECT count(*) FROM sur WHERE id <> root) AS merged, count(entity_id) AS mentions, count(*) - count(entity_id) AS unlinked, count(DISTINCT surface) AS writings, count(DISTINCT (domain, relative_path)) AS files FROM file_profile_entities")
def b_overview(spark: SparkSession, d: str) -> DataFrame:
    """The base in numbers."""
    return base.overview(_entities(spark, d))


@query("""WITH e AS (SELECT * FROM file_profile_entities), r AS (SELECT profile_id AS id, CASE WHEN profile_id % 7 = 0 THEN profile_id + 100000 WHEN profile_id % 5 = 0 THEN profile_id WHEN profile_id % 3 = 0 THEN profile_id - 1 END AS merged_into FROM file_profiles)
    SELECT 'blank_surface' AS "check", count(*) FILTER (surface IS NULL OR trim(surface) = '') AS n FROM e UNION ALL SELECT 'missing_type', count(*) - count(type_id) FROM e UNION ALL SELECT 'missing_role', count(*) - count(role) FROM e
    UNION ALL SELECT 'confidence_out_of_range', count(*) FILTER (NOT coalesce(confidence, 0) BETWEEN 0 AND 1) FROM e UNION ALL SELECT 'missing_path', count(*) - count(relative_path) FROM e UNION ALL SELECT 'repeated_key', count(*) - count(DISTINCT row_id) FROM e
    UNION ALL SELECT 'dangling_mention', count(*) FROM e WHERE relative_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM file_profiles f WHERE f.domain = e.domain AND f.relative_path = e.relative_path)
    UNION ALL SELECT 'repeated_file', count(*) FROM (SELECT 1 FROM file_profiles GROUP BY domain, relative_path HAVING count(*) > 1) UNION ALL SELECT 'redirect_to_nothing', count(*) FROM r WHERE merged_into IS NOT NULL AND merged_into NOT IN (SELECT id FROM r)
    UNION ALL SELECT 'redirect_to_itself', count(*) FILTER (id = merged_into) FROM r UNION ALL SELECT 'several_redirects', count(*) FROM (SELECT 1 FROM r GROUP BY id HAVING count(DISTINCT merged_into) > 1)""")
def b_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Broken invariants of the base, here with redirects partly to nothing and to themselves."""
    files = table(spark, d, "file_profiles")
    p = F.col("profile_id")
    redirects = files.select(p.alias("id"), F.when(p % 7 == 0, p + 100000).when(p % 5 == 0, p).when(p % 3 == 0, p - 1).alias("merged_into"))
    return base.integrity(_entities(spark, d), files, redirects)


@query(_KB + ", o AS (SELECT entity_id FROM em GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1), x AS (SELECT em.* FROM em JOIN o USING (entity_id)) " + " UNION ALL ".join(f"SELECT '{s}' AS section, {c} AS key, count(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY 2" for s, c in (("role", "role"), ("type", "type_id"), ("domain", "domain"), ("writing", "surface"), ("source", "source"))))
def b_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The sheet of the most mentioned entity."""
    e = _entities(spark, d)
    most = base.effective_mentions(e).groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").first()
    return base.sheet(e, most["entity_id"] if most else -1)


@query(_KB + f", r AS (SELECT DISTINCT entity_id, array_to_string(list_sort({_WORDS.format('surface')}), ' ') AS key FROM em), f AS (SELECT key, min(entity_id) AS least FROM r WHERE key <> '' GROUP BY 1 HAVING count(*) > 1) SELECT DISTINCT least AS a, entity_id AS b FROM r JOIN f USING (key) WHERE entity_id <> least")
def b_partners(spark: SparkSession, d: str) -> DataFrame:
    """Entities that may be one, by their words."""
    return base.partners(_entities(spark, d))


@query(_KB + ", x AS (SELECT entity_id, name, count(*) AS mentions FROM em GROUP BY ALL) SELECT entity_id, name, mentions, (SELECT count(*) FROM x) AS total FROM x ORDER BY mentions DESC, entity_id LIMIT 25 OFFSET 25")
def b_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of entities with the total of all."""
    found = base.effective_mentions(_entities(spark, d)).groupBy("entity_id", "name").agg(F.count("*").alias("mentions"))
    return base.page(found, [F.desc("mentions"), F.asc("entity_id")], 25, 25)


@query(f"SELECT DISTINCT {_FOLD.format('surface')} AS form FROM file_profile_entities WHERE surface IS NOT NULL UNION SELECT {_FOLD.format('value')} FROM file_profile_fields WHERE kind IN ('role_surface', 'letterhead') AND value IS NOT NULL")
def b_name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of a name the base knows, from links and from profiles."""
    from lectern.functions.text import fold

    a = _entities(spark, d).where("surface is not null").select(fold(F.col("surface")).alias("form"))
    b = table(spark, d, "file_profile_fields").where(F.col("kind").isin("role_surface", "letterhead") & F.col("value").isNotNull()).select(fold(F.col("value")).alias("form"))
    return a.union(b).distinct()


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY surface ORDER BY confidence DESC NULLS LAST, row_id) AS r FROM file_profile_entities) WHERE r = 1")
def b_first_per_name(spark: SparkSession, d: str) -> DataFrame:
    """The surest mention of each writing."""
    return best_per(_entities(spark, d).select("row_id", "surface", "confidence"), ["surface"], [F.desc_nulls_last("confidence"), F.asc("row_id")]).select("row_id")


@query("SELECT source, row_id FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source, relative_path ORDER BY confidence DESC NULLS LAST, row_id) AS r FROM file_profile_entities) WHERE r <= 2")
def b_capped(spark: SparkSession, d: str) -> DataFrame:
    """Each source's two surest mentions a file: the cap on what a source may say."""
    e = _entities(spark, d).withColumn("of", F.struct("source", "relative_path"))
    return knowledge.capped(e, "of", 2).select("source", "row_id")


@query(_KB + ", x AS (SELECT entity_id, name, count(DISTINCT (domain, relative_path)) AS sources FROM em GROUP BY ALL) SELECT entity_id, name FROM x WHERE sources >= 1 AND lower(strip_accents(name)) LIKE '%de%' ESCAPE '\\'")
def b_listed(spark: SparkSession, d: str) -> DataFrame:
    """Live entities whose name holds a text, its signs for patterns taken as they are."""
    from lectern.functions.text import escape_like, fold

    live = base.supporting_sources(_entities(spark, d)).where(F.col("status").isin("active", "candidate")).select("entity_id")
    pattern = F.concat(F.lit("%"), escape_like(fold(F.lit("dé"))), F.lit("%"))
    named = base.effective_mentions(_entities(spark, d)).select("entity_id", "name").distinct()
    return named.join(live, "entity_id", "left_semi").select("*", pattern.alias("p"), fold(F.col("name")).alias("folded")).where("folded like p escape '\\\\'").select("entity_id", "name")


@query("SELECT DISTINCT value AS id FROM file_profile_fields WHERE kind = 'role_surface' AND value IS NOT NULL AND value NOT IN (SELECT surface FROM file_profile_entities WHERE surface IS NOT NULL) AND value NOT IN (SELECT correspondent FROM documents WHERE correspondent IS NOT NULL) AND value NOT IN (SELECT patient FROM rendez_vous_lilas WHERE patient IS NOT NULL) AND value NOT IN (SELECT medecin FROM rendez_vous_lilas WHERE medecin IS NOT NULL) AND value NOT IN (SELECT caisse FROM rendez_vous_lilas WHERE caisse IS NOT NULL)")
def b_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Names of profiles that none of five relations refers to."""
    id_ = lambda df, c: df.where(F.col(c).isNotNull()).select(F.col(c).alias("id"))
    r = table(spark, d, "rendez_vous_lilas")
    names = id_(table(spark, d, "file_profile_fields").where("kind = 'role_surface'"), "value").distinct()
    return knowledge.orphans(names, id_(_entities(spark, d), "surface"), id_(table(spark, d, "documents"), "correspondent"), id_(r, "patient"), id_(r, "medecin"), id_(r, "caisse"))


@query(_KB + "SELECT entity_id, list_sort(list_distinct(list(relative_path))) AS files FROM em WHERE domain = 'documents' AND relative_path IN (SELECT relative_path FROM file_profiles WHERE state = 'analysed') GROUP BY 1")
def b_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each entity within a scope, here documents that were analysed. An entity's files are listed once each."""
    scope = table(spark, d, "file_profiles").where("state = 'analysed'").select("relative_path")
    rows = base.effective_mentions(_entities(spark, d)).where("domain = 'documents'").join(scope, "relative_path", "left_semi")
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_set("relative_path")).alias("files"))


@query("SELECT domain, title AS name, count(*) AS n FROM file_profiles WHERE title IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def b_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles that several files of a domain have."""
    return table(spark, d, "file_profiles").where("title is not null").groupBy("domain", F.col("title").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query(_KB + ", e AS (SELECT DISTINCT domain, relative_path, entity_id, role FROM em) SELECT DISTINCT a.entity_id AS subject, b.entity_id AS issuer FROM e a JOIN e b ON a.domain = b.domain AND a.relative_path = b.relative_path WHERE a.role = 'subject' AND b.role = 'issuer' AND a.entity_id <> b.entity_id")
def b_edges(spark: SparkSession, d: str) -> DataFrame:
    """Surviving entities a file names as its subject and as its issuer."""
    e = base.effective_mentions(_entities(spark, d)).select("domain", "relative_path", "entity_id", "role").distinct()
    end = lambda role, name: e.where(F.col("role") == role).select("domain", "relative_path", F.col("entity_id").alias(name))
    return end("subject", "subject").join(end("issuer", "issuer"), ["domain", "relative_path"]).where("subject <> issuer").select("subject", "issuer").distinct()

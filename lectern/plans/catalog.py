"""Queries of the relational, search, finder, knowledge and pipeline operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import numbers, text
from lectern.functions.phonetic import phonetic_key
from lectern.operators import finder, knowledge, pipeline, relational, search
from lectern.session import shared_dir, table
from lectern.sources import documents as readers
from lectern.sources import sinks
from lectern.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_BARE = "lower(strip_accents({}))"
_STEM = r"regexp_replace(regexp_extract(relative_path, '([^/]*)$', 1), '\.[^.]*$', '')"

# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) AND o_totalprice > 200000")
def j_inner_chain(spark: SparkSession, d: str) -> DataFrame:
    """Orders through customer and nation to one region: filters first, small dimensions by size."""
    region = table(spark, d, "region")
    first = region.join(region.agg(F.min("r_name").alias("r_name")), "r_name").select("r_regionkey")
    nation = table(spark, d, "nation").join(first, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT DISTINCT p.profile_id FROM file_profiles p LEFT JOIN (SELECT relative_path, max(TRY_CAST(split_part(engine_version, '.', 2) AS INT)) AS v FROM ocr_page_cache GROUP BY 1) o ON p.relative_path = o.relative_path WHERE p.format IN ('pdf', 'jpg') AND (o.v IS NULL OR o.v < p.build_version)")
def j_left_outdated(spark: SparkSession, d: str) -> DataFrame:
    """Scanned files whose pages are missing or were read by an older version."""
    seen = table(spark, d, "ocr_page_cache").groupBy("relative_path").agg(F.max(F.split("engine_version", r"\.")[1].try_cast("int")).alias("build_version"))
    due = table(spark, d, "file_profiles").where(F.col("format").isin("pdf", "jpg"))
    return relational.outdated(due, seen, "relative_path", "build_version").select("profile_id").distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j_semi_exists(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a pending order."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j_anti_orphan(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order."""
    return knowledge.orphans(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))).select(F.col("id").alias("c_custkey"))


@query("SELECT DISTINCT surface FROM file_profile_entities e WHERE domain = 'documents' AND NOT EXISTS (SELECT 1 FROM file_profile_entities x WHERE x.surface = e.surface AND x.domain = 'data')")
def j_semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand in documents and in no table."""
    e = table(spark, d, "file_profile_entities").select("surface", "domain")
    return relational.in_one_not_other(e.select("surface").distinct(), e.where("domain = 'documents'"), e.where("domain = 'data'"), "surface")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS priorities FROM customer")
def j_scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """Counts per customer, aggregated once and joined."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("priorities"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0, ["orders", "priorities"])


@query("SELECT n_nationkey AS id, (SELECT count(*) FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey = n_nationkey OR s_nationkey = n_nationkey) AS edges FROM nation")
def j_either_side(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of customer and supplier of one number, counted by the nation on either side."""
    edges = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    return relational.either_side(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), edges, "id", "a", "b")


@query("SELECT DISTINCT a.n_name AS name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j_self(spark: SparkSession, d: str) -> DataFrame:
    """Nations of the same region, in pairs."""
    n = table(spark, d, "nation")
    a, b = n.toDF("ka", "name", "r"), n.toDF("kb", "other", "r")
    return a.join(b, "r").where("ka < kb").select("name", "other").distinct()


@query("WITH RECURSIVE c(id, root, n) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT id, CASE WHEN root % 5 = 0 THEN root ELSE root - 1 END, n + 1 FROM c WHERE n < 6) SELECT id AS node, min(root) AS root FROM c GROUP BY 1")
def j_recursive_chain(spark: SparkSession, d: str) -> DataFrame:
    """Where a chain of redirects ends, by doubling."""
    n = F.col("n_nationkey")
    return relational.follow_redirects(table(spark, d, "nation").select(n.alias("id"), F.when(n % 5 != 0, n - 1).alias("merged_into")))


@query("WITH s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS t FROM orders GROUP BY 1) SELECT o_custkey FROM s WHERE f <= DATE '1996-06-30' AND t >= DATE '1996-01-01'")
def j_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose span of orders touches half a year."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("f"), F.max(F.to_date("o_orderdate")).alias("t"))
    lo, hi = F.lit("1996-01-01").cast("date"), F.lit("1996-06-30").cast("date")
    return s.where(finder.spans_overlap(F.col("f"), F.col("t"), lo, hi)).select("o_custkey")


@query(f"SELECT DISTINCT a.surface AS a, b.surface AS b FROM (SELECT DISTINCT surface, array_to_string(list_sort(list_filter(string_split_regex({_BARE.format('surface')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ('m','mme','mlle','monsieur','madame','dr','dre','docteur','prof','me','herr','frau','mr','mrs','ms'))), ' ') AS k FROM file_profile_entities) a JOIN (SELECT DISTINCT surface, array_to_string(list_sort(list_filter(string_split_regex({_BARE.format('surface')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ('m','mme','mlle','monsieur','madame','dr','dre','docteur','prof','me','herr','frau','mr','mrs','ms'))), ' ') AS k FROM file_profile_entities) b ON a.k = b.k WHERE a.surface < b.surface")
def j_token_set(spark: SparkSession, d: str) -> DataFrame:
    """Names of the same words in any order."""
    e = table(spark, d, "file_profile_entities").select("surface").distinct().withColumn("k", knowledge.token_set_key(F.col("surface")))
    return e.toDF("a", "k").join(e.toDF("b", "k"), "k").where("a < b").select("a", "b")


# Aggregates, windows, set operations


@query("SELECT content_id, count(*) AS n FROM file_profiles GROUP BY 1 HAVING count(*) > 1")
def a_having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Contents held under several paths."""
    return table(spark, d, "file_profiles").groupBy("content_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT surface, count(DISTINCT relative_path) AS files, count(*) AS mentions, max(confidence) AS confidence FROM file_profile_entities GROUP BY 1")
def a_per_entity(spark: SparkSession, d: str) -> DataFrame:
    """Files, mentions and best confidence of each name."""
    return table(spark, d, "file_profile_entities").groupBy("surface").agg(F.countDistinct("relative_path").alias("files"), F.count("*").alias("mentions"), F.max("confidence").alias("confidence"))


@query("SELECT 'folder' AS facet, regexp_extract(relative_path, '^([^/]*)/', 1) AS value, count(*) AS n FROM file_profiles GROUP BY 2 UNION ALL SELECT 'format' AS facet, format AS value, count(*) AS n FROM file_profiles WHERE format IS NOT NULL GROUP BY ALL UNION ALL SELECT 'state', state, count(*) FROM file_profiles WHERE state IS NOT NULL GROUP BY ALL UNION ALL SELECT 'business_type', business_type, count(*) FROM file_profiles WHERE business_type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'year', document_date[1:4], count(*) FROM file_profiles WHERE document_date IS NOT NULL GROUP BY ALL")
def a_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by format, state, type, year and folder in one pass."""
    rows = table(spark, d, "file_profiles").withColumn("year", F.substring("document_date", 1, 4)).withColumn("folder", F.regexp_extract("relative_path", "^([^/]*)/", 1))
    return relational.facets(rows, ["format", "state", "business_type", "year", "folder"])


@query("SELECT 'format' AS facet, format AS value, count(*) AS n FROM file_profiles WHERE format IS NOT NULL AND state = 'analysed' GROUP BY ALL UNION ALL SELECT 'state', state, count(*) FROM file_profiles WHERE state IS NOT NULL AND format = 'pdf' GROUP BY ALL")
def a_facets_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each facet's counts under the other facet's filter."""
    return relational.facets_leave_one_out(table(spark, d, "file_profiles"), {"format": F.col("format") == "pdf", "state": F.col("state") == "analysed"})


@query("SELECT count(*) AS files, count(*) FILTER (state = 'analysed') AS searched, count(*) FILTER (state = 'unreadable') AS unreadable, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (business_type IS NULL) AS untyped FROM file_profiles WHERE domain = 'documents'")
def a_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the scope a search reaches."""
    return finder.coverage(table(spark, d, "file_profiles").where("domain = 'documents'"))


@query("WITH p AS (SELECT string_split(relative_path, '/') AS s FROM file_profiles), a AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS folder FROM p) SELECT folder, len(string_split(folder, '/')) AS depth, count(*) AS files FROM a GROUP BY ALL")
def a_folders(spark: SparkSession, d: str) -> DataFrame:
    """The folder tree with files under each folder."""
    return finder.folders(table(spark, d, "file_profiles"), "relative_path")


@query("SELECT relative_path, row_id FROM (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY confidence DESC, row_id) AS r FROM file_profile_entities) WHERE r <= 5")
def w_best_five(spark: SparkSession, d: str) -> DataFrame:
    """Each file's five surest names."""
    return relational.best_per(table(spark, d, "file_profile_entities").select("relative_path", "row_id", "confidence"), ["relative_path"], [F.desc("confidence"), F.asc("row_id")], 5).select("relative_path", "row_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(len(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 100")
def w_running_budget(spark: SparkSession, d: str) -> DataFrame:
    """A user's newest events while their texts fit."""
    e = table(spark, d, "events").select("user_id", "event_id", F.length("props").alias("size"))
    return relational.running_budget(e, ["user_id"], [F.desc("event_id")], "size", 100).select("user_id", "event_id")


@query("WITH b AS (SELECT value, event_id FROM events ORDER BY event_id DESC LIMIT 2000) SELECT count(*) AS n, count(*) FILTER (value > 50) AS with_reason, round(avg(value), 4) AS mean, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median FROM b")
def w_ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Measures over the last 2,000 events."""
    return ingest.diagnostics(table(spark, d, "events").withColumn("reason", F.when(F.col("value") > 50, "high")), "event_id", "value", "reason", 2000)


@query("SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION SELECT s_name FROM supplier WHERE s_acctbal < 0)")
def s_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Names that owe on either side."""
    a = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("name"))
    return a.union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_name")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def s_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Nations on both sides."""
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def s_except(spark: SparkSession, d: str) -> DataFrame:
    """Nations without a rich supplier."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct())


@query("SELECT relative_path, min(s) AS source FROM (SELECT relative_path, 0 AS s FROM file_profile_entities WHERE type_id = 'person' UNION ALL SELECT relative_path, 1 FROM ocr_page_cache UNION ALL SELECT relative_path, 2 FROM file_profiles) GROUP BY 1")
def s_union_with_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files by the first source that names them."""
    parts = [table(spark, d, "file_profile_entities").where("type_id = 'person'"), table(spark, d, "ocr_page_cache"), table(spark, d, "file_profiles")]
    return relational.union_with_rank([p.select("relative_path") for p in parts], "relative_path")


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT p_partkey AS k, p_size AS v FROM part) o FULL JOIN (SELECT p_partkey + 1000 AS k, -p_size AS v FROM part) n ON o.k = n.k")
def k_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows replaced by newer ones of the same key."""
    p = table(spark, d, "part")
    return relational.upsert(p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), p.select((F.col("p_partkey") + 1000).alias("k"), (-F.col("p_size")).alias("v")), ["k"])


@query("SELECT p_partkey AS k, p_size AS v FROM part UNION ALL SELECT p_partkey + 1000, -p_size FROM part WHERE p_partkey + 1000 NOT IN (SELECT p_partkey FROM part)")
def k_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """New keys added, known ones left."""
    p = table(spark, d, "part")
    return relational.insert_or_ignore(p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), p.select((F.col("p_partkey") + 1000).alias("k"), (-F.col("p_size")).alias("v")), ["k"])


@query("SELECT row_id, relative_path FROM ocr_page_cache WHERE relative_path NOT IN (SELECT relative_path FROM ocr_page_cache WHERE engine_version = '5.3.0') UNION ALL SELECT -row_id, relative_path FROM ocr_page_cache WHERE engine_version = '5.3.0'")
def k_replace_documents(spark: SparkSession, d: str) -> DataFrame:
    """All pages of the documents a new reading brings, replaced."""
    o = table(spark, d, "ocr_page_cache").select("row_id", "relative_path", "engine_version")
    new = o.where("engine_version = '5.3.0'").select((-F.col("row_id")).alias("row_id"), "relative_path")
    return relational.replace_documents(o.select("row_id", "relative_path"), new, "relative_path")


@query("SELECT row_id FROM ocr_page_cache WHERE relative_path IN (SELECT relative_path FROM file_profiles WHERE state = 'analysed')")
def k_retain(spark: SparkSession, d: str) -> DataFrame:
    """Pages of files that are still there."""
    return relational.retain(table(spark, d, "ocr_page_cache").select("row_id", "relative_path"), table(spark, d, "file_profiles").where("state = 'analysed'"), "relative_path").select("row_id")


# Scalar functions


@query(f"SELECT DISTINCT surface, {_BARE.format('surface')} AS folded FROM file_profile_entities")
def f_fold(spark: SparkSession, d: str) -> DataFrame:
    """Names without case and accents."""
    return table(spark, d, "file_profile_entities").select("surface", text.fold(F.col("surface")).alias("folded")).distinct()


@query(f"SELECT DISTINCT surface, regexp_replace(regexp_replace({_BARE.format('surface')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'x', 'x') AS word FROM file_profile_entities")
def f_fold_word(spark: SparkSession, d: str) -> DataFrame:
    """Names as letters and digits alone."""
    return table(spark, d, "file_profile_entities").select("surface", text.fold_word(F.col("surface")).alias("word")).distinct()


@query("SELECT row_id, upper(regexp_replace(no_avs, '[^A-Za-z0-9]', '', 'g')) AS compact FROM patients_ch")
def f_identifier(spark: SparkSession, d: str) -> DataFrame:
    """Insurance numbers without separators."""
    return table(spark, d, "patients_ch").select("row_id", text.normalize_identifier(F.col("no_avs")).alias("compact"))


@query(r"SELECT row_id, CAST(TRY_CAST(CASE WHEN regexp_full_match(trim(date_de_naissance), '\d{4}-\d\d-\d\d') THEN trim(date_de_naissance) WHEN regexp_full_match(trim(date_de_naissance), '\d\d?[/.-]\d\d?[/.-]\d{4}') THEN regexp_extract(date_de_naissance, '(\d+)\D(\d+)\D(\d{4})', 3) || '-' || lpad(regexp_extract(date_de_naissance, '(\d+)\D(\d+)\D(\d{4})', 2), 2, '0') || '-' || lpad(regexp_extract(date_de_naissance, '(\d+)\D(\d+)', 1), 2, '0') END AS DATE) AS VARCHAR) AS born FROM patients_ch")
def f_parse_date(spark: SparkSession, d: str) -> DataFrame:
    """Birth dates as calendar dates."""
    return table(spark, d, "patients_ch").select("row_id", numbers.parse_date(F.col("date_de_naissance")).cast("string").alias("born"))


@query(r"SELECT row_id, CASE WHEN regexp_matches(montant, '^CHF ') THEN 'CHF' WHEN regexp_matches(montant, ' €$') THEN '€' END AS unit, trim(regexp_replace(regexp_replace(montant, '^CHF ', ''), ' €$', '')) AS bare FROM rendez_vous_lilas WHERE montant IS NOT NULL")
def f_strip_unit(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and their units."""
    bare, unit = numbers.strip_unit(F.col("montant"))
    return table(spark, d, "rendez_vous_lilas").where("montant is not null").select("row_id", unit.alias("unit"), bare.alias("bare"))


@query(r"SELECT profile_id, CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}') THEN s[1:10] END AS date FROM (SELECT profile_id, " + _STEM + " AS s FROM file_profiles)")
def f_date_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Dates that file names open with."""
    stem = F.regexp_replace(F.regexp_extract("relative_path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return table(spark, d, "file_profiles").select("profile_id", numbers.split_date_prefix(stem)[0].alias("date"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\[(\d{1,6})\]', 1), lambda x: CAST(x AS INT) > 3 OR CAST(x AS INT) < 1), lambda x: CAST(x AS INT)))) AS wrong FROM documents WHERE text LIKE '%[%'")
def f_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of texts beyond three sources, ascending."""
    return table(spark, d, "documents").where(F.col("text").contains("[")).select("doc_id", text.citations_out_of_range(F.col("text"), F.lit(3)).alias("wrong"))


@query(r"SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\{\{[^{}\n]{1,60}?\}\}|«[^«»\n]{1,60}?»|\[[^\[\]\n]{1,60}?\]'), lambda f: trim(regexp_replace(f, '^(\{\{|«|\[)\s*|\s*(\}\}|»|\])$', '', 'g'))), lambda n: n <> '' AND NOT regexp_full_match(n, '\d+')))) AS fields FROM documents WHERE source = 'modeles' AND text IS NOT NULL")
def f_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Fields that templates ask for."""
    return table(spark, d, "documents").where("source = 'modeles' and text is not null").select("doc_id", F.size(text.placeholders(F.col("text"))).alias("fields"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def f_json(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON column."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def f_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests of texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("WITH w AS (SELECT DISTINCT lower(strip_accents(surface)) AS w FROM file_profile_entities WHERE surface <> '') SELECT a.w AS a, b.w AS b, damerau_levenshtein(a.w, b.w) AS edits FROM w a JOIN w b ON a.w < b.w WHERE damerau_levenshtein(a.w, b.w) <= 2")
def f_damerau(spark: SparkSession, d: str) -> DataFrame:
    """Writings of names that are within two edits of one another."""
    return text.near_pairs(text.fold(F.col("surface")), table(spark, d, "file_profile_entities"))


@query()
def f_phonetic(spark: SparkSession, d: str) -> DataFrame:
    """Phonetic keys of names, with how many share each."""
    e = table(spark, d, "file_profile_entities").select(F.explode(text.words_of(F.col("surface"))).alias("word")).distinct()
    return e.groupBy(phonetic_key(F.col("word")).alias("key")).agg(F.count("*").alias("words"), F.min("word").alias("first"))


@query()
def f_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("n", "sentence"))


@query()
def f_unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers a file's title states that its path doesn't hold."""
    return table(spark, d, "file_profiles").where("title is not null").select("profile_id", numbers.unsupported_numbers(F.col("title"), F.array("relative_path")).alias("numbers"))


@query()
def f_dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    """All dates that texts write."""
    return table(spark, d, "documents").select("doc_id", F.explode(numbers.dates_in_text(F.col("text"))).alias("date"))


@query()
def f_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Words around the first mention of a scan."""
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), F.lit("scanner")).alias("excerpt")).where("excerpt is not null")


# Search

_WORDS = f"list_filter(string_split_regex({_BARE.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'scanner')) AS a, len(list_filter(w, lambda x: x = 'genou')) AS b FROM w WHERE len(w) > 0),
    s AS (SELECT count(*) AS N, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM r)
    SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, CASE WHEN a > 0 THEN ln((N - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * r.n / m)) ELSE 0 END + CASE WHEN b > 0 THEN ln((N - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * r.n / m)) ELSE 0 END AS score FROM r, s WHERE a > 0 OR b > 0) ORDER BY round(score, 4) DESC, doc_id LIMIT 20""".replace("count(*) AS N", "count(*) AS total").replace("(N -", "(total -"))
def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The best texts for two words."""
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", ["scanner", "genou"]).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' scanner du genou ')")
def q_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold a phrase."""
    return table(spark, d, "documents").where(search.phrase(F.col("text"), "Scanner du genou")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'scanner') AND len(list_filter({_WORDS}, lambda x: starts_with(x, 'card'))) > 0")
def q_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a word and one that begins so."""
    return table(spark, d, "documents").where(search.all_words(F.col("text"), ["scanner", "card"], last_is_prefix=True)).select("doc_id")


@query(f"SELECT x AS term, count(DISTINCT doc_id) AS documents, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS x FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) > 10")
def q_postings(spark: SparkSession, d: str) -> DataFrame:
    """Terms by documents and occurrences."""
    p = search.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("n")).where("documents > 10")


def _vector(spark: SparkSession, d: str) -> DataFrame:
    """The query vector: that of the first row."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding")


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({_COS}, 4) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def q_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors to one."""
    near = search.cosine(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d))
    return near.orderBy(F.desc("cosine"), "vec_id").limit(10).withColumn("cosine", F.round("cosine", 4))


@query(f"SELECT label, vec_id FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round({_COS}, 5) DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE r = 1")
def q_best_per_label(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of each label."""
    e = table(spark, d, "embeddings")
    near = search.cosine(e, "vec_id", "embedding", _vector(spark, d)).join(e.select("vec_id", "label"), "vec_id")
    return near.groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("cosine", 5), -F.col("vec_id"))).alias("vec_id"))


@query(f"SELECT vec_id, round(s, 3) AS score, hit FROM (SELECT e.vec_id, e.label = 3 AS hit, {_COS} + CASE WHEN e.label = 3 THEN 0.2 ELSE 0 END AS s, {_COS} AS c FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE hit OR c >= 0.15")
def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Cosine with a bonus for hits, here the vectors of one label."""
    e = table(spark, d, "embeddings")
    return search.hybrid(search.cosine(e, "vec_id", "embedding", _vector(spark, d)), e.where("label = 3"), "vec_id").withColumn("score", F.round("score", 3))


@query()
def q_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """Each source's best passages on a subject while they fit 6,000 code points."""
    docs = table(spark, d, "documents")
    scored = search.bm25(docs, "doc_id", "text", ["scanner", "genou"]).join(docs.where("source is not null").select("doc_id", "source", "n_chars"), "doc_id")
    return search.within_budget(scored, "source", "doc_id", "n_chars")


@query()
def q_best_passage(spark: SparkSession, d: str) -> DataFrame:
    """Each scanned file's best page on a subject, or its first."""
    o = table(spark, d, "ocr_page_cache")
    return search.best_passage_per_document(search.bm25(o, "row_id", "text", ["cardiologie"]), o, "relative_path", "row_id", ["page_number", "row_id"]).withColumn("score", F.round("score", 4))


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT q.vec_id AS question, q.label, e.vec_id AS document, e.label AS l, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS k FROM embeddings e, q),
    g AS (SELECT question, count(*) FILTER (l = label) AS n, count(*) FILTER (l = label AND k <= 10) AS found, min(k) FILTER (l = label AND k <= 10) AS best, sum(CASE WHEN l = label AND k <= 10 THEN 1 / log2(k + 1) ELSE 0 END) AS dcg FROM r GROUP BY 1)
    SELECT question, round(found / n, 6) AS recall, round(coalesce(1 / best, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g""")
def q_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the ten nearest vectors of every vector whose id is divisible by 100, judged by their label."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    ranked = search.nearest(e, "vec_id", "embedding", asked, 10).select(F.col("query").alias("question"), F.col("vec_id").alias("document"), F.col("rank").alias("k"))
    judged = asked.select(F.col("vec_id").alias("question"), "label").join(e.select(F.col("vec_id").alias("document"), "label"), "label").select("question", "document")
    return search.recall_mrr_ndcg(ranked, judged, "question", "document", "k").select("question", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


# Finder


@query(f"SELECT profile_id FROM file_profiles WHERE list_contains(string_split_regex({_BARE.format(_STEM)}, '[^\\p{{L}}\\p{{N}}]+'), 'courrier') AND len(list_filter(string_split_regex({_BARE.format(_STEM)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: starts_with(x, 'pat'))) > 0")
def n_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Files by words of their names, the last begun."""
    return finder.by_name(table(spark, d, "file_profiles"), "profile_id", "relative_path", ["courrier", "pat"])


@query("SELECT profile_id FROM file_profiles WHERE format IN ('pdf', 'docx') AND state = 'analysed' AND starts_with(relative_path, 'courriers-entrants/') AND document_date >= '2024-01-01' AND document_date[1:7] <= '2024-06'")
def n_filters(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives within a facet, all facets together."""
    return table(spark, d, "file_profiles").where(finder.passes(["pdf", "docx"], ["analysed"], None, "courriers-entrants", "2024-01-01", "2024-06")).select("profile_id")


@query("SELECT relative_path, list_sort(list_distinct(list(r))) AS reasons, max(w) AS weight FROM (SELECT relative_path, 'name' AS r, 5 AS w FROM file_profiles WHERE contains(relative_path, 'courrier-patient') UNION ALL SELECT relative_path, 'passage', 1 FROM ocr_page_cache WHERE contains(text, 'cardiologie') UNION ALL SELECT relative_path, 'date', 3 FROM file_profiles WHERE starts_with(document_date, '2024')) GROUP BY 1")
def n_channels(spark: SparkSession, d: str) -> DataFrame:
    """Files any channel found, with reasons."""
    p = table(spark, d, "file_profiles")
    parts = {
        "name": p.where(F.col("relative_path").contains("courrier-patient")),
        "passage": table(spark, d, "ocr_page_cache").where(F.col("text").contains("cardiologie")),
        "date": p.where(finder.date_within(F.col("document_date"), F.lit("2024"))),
    }
    return finder.channels(parts, "relative_path")


@query(r"SELECT relative_path, coalesce(document_date, CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}') THEN s[1:10] END, strftime(profiled_at, '%Y-%m-%d')) AS rank_date FROM (SELECT *, " + _STEM + " AS s FROM file_profiles) ORDER BY 2 DESC, 1 LIMIT 5")
def n_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest five files by the date they have."""
    return finder.latest(table(spark, d, "file_profiles")).select("relative_path", "rank_date")


@query("SELECT relative_path, 'name' AS reason FROM file_profiles WHERE relative_path LIKE '%/registre-central-lilas.xlsx'")
def n_reference(spark: SparkSession, d: str) -> DataFrame:
    """The file a reference names."""
    return finder.resolve_reference(table(spark, d, "file_profiles"), "relative_path", "registre-central-lilas.xlsx")


# Knowledge


@query("SELECT surface AS name, count(*) AS mentions, count(DISTINCT (domain, relative_path)) AS files, CASE WHEN count(DISTINCT (domain, relative_path)) >= 2 THEN 'active' ELSE 'candidate' END AS status FROM file_profile_entities WHERE entity_id IS NOT NULL GROUP BY 1")
def e_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Linked names with their status by sources."""
    e = table(spark, d, "file_profile_entities").where("entity_id is not null").groupBy(F.col("surface").alias("name")).agg(F.count("*").alias("mentions"), F.countDistinct("domain", "relative_path").alias("files"))
    return knowledge.promoted(e)


@query()
def e_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names as entities."""
    return knowledge.promoted(knowledge.entities(table(spark, d, "file_profile_entities")))


@query()
def e_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every unlinked name resolved against the linked ones."""
    e = table(spark, d, "file_profile_entities")
    base = e.where("entity_id is not null").select(F.col("entity_id").cast("bigint").alias("id"), F.col("surface").alias("name")).distinct()
    return knowledge.resolve(e.where("entity_id is null").select(F.col("surface").alias("name")), base)


@query("SELECT patient AS subject, medecin AS object, 'treated_by' AS predicate, count(*) AS n, 0.8::DOUBLE AS confidence FROM rendez_vous_lilas WHERE patient IS NOT NULL AND medecin IS NOT NULL GROUP BY ALL")
def e_relations(spark: SparkSession, d: str) -> DataFrame:
    """Patients and doctors that rows put together."""
    return knowledge.relations(table(spark, d, "rendez_vous_lilas").withColumn("c", F.lit(0.8)), "patient", "medecin", "treated_by", ["c"])


@query("WITH e AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN id % 10 < 3 THEN id - id % 10 ELSE id END AS entity_id, sum(n) AS n FROM e GROUP BY 1")
def e_effective(spark: SparkSession, d: str) -> DataFrame:
    """Mentions counted for the entities theirs were merged into, here customers in chains of three."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"))
    c = F.col("entity_id")
    redirects = o.distinct().select(c.alias("id"), F.when((c % 10).between(1, 2), c - 1).alias("merged_into"))
    ids = redirects.select(F.explode(F.array("id", "merged_into")).alias("id")).where("id is not null").distinct().join(redirects, "id", "left").select("id", F.coalesce("merged_into", F.when((F.col("id") % 10).between(1, 2), F.col("id") - 1)).alias("merged_into"))
    roots = ids.unionByName(ids.where((F.col("id") % 10) == 1).select((F.col("id") - 1).alias("id"), F.lit(None).cast("bigint").alias("merged_into"))).distinct()
    return knowledge.effective(o, roots).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT lower(strip_accents(surface)) AS key, relative_path, confidence FROM file_profile_entities WHERE type_id = 'location'), o AS (SELECT key FROM k GROUP BY 1 ORDER BY count(DISTINCT relative_path) DESC, key LIMIT 1),
    f AS (SELECT DISTINCT relative_path FROM file_profiles), h AS (SELECT relative_path, count(*) AS hits, max(confidence) AS confidence FROM file_profile_entities e JOIN o ON lower(strip_accents(e.surface)) = o.key WHERE relative_path IN (SELECT relative_path FROM f) GROUP BY 1),
    u AS (SELECT relative_path FROM f WHERE relative_path NOT IN (SELECT relative_path FROM file_profile_entities WHERE relative_path IS NOT NULL)), c AS (SELECT (SELECT count(*) FROM h) AS hit, (SELECT count(*) FROM u) AS unread, (SELECT count(*) FROM f) AS a, (SELECT max(confidence) FROM h) AS sure),
    z AS (SELECT hit > 0 AND sure >= 0.8 AND hit <= 0.6 * a AND a >= 8 AND a - hit - unread >= 0.3 * a AS use FROM c)
    SELECT relative_path, hits, confidence, 'entity' AS reason FROM (SELECT * FROM h ORDER BY hits DESC, confidence DESC, relative_path LIMIT 15), z WHERE use UNION ALL SELECT relative_path, 0, NULL, 'unread' FROM u, z WHERE use UNION ALL SELECT relative_path, 0, NULL, 'all' FROM f, z WHERE NOT use""")
def e_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Files a question about the place named in most files is put to."""
    e = table(spark, d, "file_profile_entities")
    most = e.where("type_id = 'location'").groupBy(text.fold(F.col("surface")).alias("key")).agg(F.countDistinct("relative_path").alias("n")).orderBy(F.desc("n"), "key").first()
    return knowledge.reduce_files(e, [most["key"]] if most else [], table(spark, d, "file_profiles").select("relative_path"))


# Pipeline and ingestion


@query()
def c_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Passages of all documents."""
    docs = table(spark, d, "documents").withColumn("page", F.lit(1))
    return pipeline.chunks(docs, "doc_id", "page", "text", pipeline.is_long(docs, "doc_id", "text"))


@query()
def c_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that half of a scanned file's pages repeat."""
    return pipeline.repeated_lines(table(spark, d, "ocr_page_cache"), "relative_path", "page_number", "text")


@query()
def c_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Pages of scans, cleaned."""
    return pipeline.cleaned(table(spark, d, "ocr_page_cache"), "relative_path", "page_number", "text").select("row_id", "text")


@query()
def c_cards(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each scanned file."""
    return pipeline.cards(table(spark, d, "ocr_page_cache"), "relative_path", "page_number", "text")


_LINES = "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL"
_MARKED, _NUMBERED, _CAPITALS = r"^(#{1,6})\s+(.+?)\s*#*$", r"^((?:\d+\.)+\d*|\d+\.)\s+\p{Lu}.{2,80}$", r"^[\p{Lu}][\p{Lu}\s\d''’/&—–-]{5,80}$"
_HEADINGS = rf"""WITH l AS ({_LINES}), h AS (SELECT doc_id, line, t, CASE WHEN regexp_extract(t, '{_MARKED}', 1) <> '' THEN length(regexp_extract(t, '{_MARKED}', 1)) WHEN regexp_extract(t, '{_NUMBERED}', 1) <> '' THEN len(list_filter(string_split(regexp_extract(t, '{_NUMBERED}', 1), '.'), lambda x: x <> '')) WHEN regexp_matches(t, '{_CAPITALS}') THEN 1 END AS level,
    trim(regexp_replace(t, '^#{{1,6}}\s+|\s*#+$', '', 'g')) AS title FROM l) """


@query(_HEADINGS + "SELECT doc_id, line, level, title FROM h WHERE level IS NOT NULL")
def c_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of all documents."""
    docs = table(spark, d, "documents").withColumn("page", F.lit(1))
    return pipeline.headings(docs, "doc_id", "page", "text").select("doc_id", "line", "level", "title")


@query(_HEADINGS + "SELECT doc_id, line, s AS section_title FROM (SELECT doc_id, line, last_value(CASE WHEN level IS NOT NULL THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS s FROM h) WHERE s IS NOT NULL")
def c_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section every line of a document is in."""
    docs = table(spark, d, "documents").withColumn("page", F.lit(1))
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", "line")
    return pipeline.assign_sections(lines, pipeline.headings(docs, "doc_id", "page", "text"), "doc_id", ["line"]).select("doc_id", "line", "section_title")


@query("SELECT p.profile_id FROM file_profiles p WHERE NOT EXISTS (SELECT 1 FROM file_profiles q WHERE q.content_id = p.content_id AND q.build_version = 2 AND p.build_version = 2)")
def i_due(spark: SparkSession, d: str) -> DataFrame:
    """Files not indexed under the present version."""
    p = table(spark, d, "file_profiles")
    return ingest.due(p, p.where("build_version = 2"), ("content_id", "build_version")).select("profile_id")


@query("SELECT n.row_id, EXISTS (SELECT 1 FROM ocr_page_cache o WHERE o.engine_version = '5.3.0' AND o.relative_path = n.relative_path AND o.page_number = n.page_number AND o.text = n.text) AS reused FROM ocr_page_cache n WHERE n.engine_version <> '5.0.1'")
def i_reuse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of pages one version read, taken over where another one read the same text."""
    pages = table(spark, d, "ocr_page_cache").withColumn("chunk_id", F.format_string("%s#p%d", "relative_path", "page_number"))
    old = pages.where("engine_version = '5.3.0'").select("chunk_id", "text", F.array(F.col("page_number").cast("float")).alias("embedding"))
    new = pages.where("engine_version <> '5.0.1'").select("row_id", "chunk_id", "text", F.lit(None).cast("array<float>").alias("embedding"))
    return ingest.reuse_vectors(new, old).select("row_id", F.col("embedding").isNotNull().alias("reused"))


@query("SELECT row_id, engine_version = '5.4.1' AS kept FROM ocr_page_cache")
def i_reset_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all pages after a change of the model, here named by the reader's version."""
    pages = table(spark, d, "ocr_page_cache").select("row_id", F.array(F.lit(1.0)).alias("embedding"), F.col("engine_version").alias("model"))
    return ingest.reset_vectors(pages, "5.4.1").select("row_id", F.col("embedding").isNotNull().alias("kept"))


@query("SELECT row_id FROM ocr_page_cache n WHERE NOT EXISTS (SELECT 1 FROM ocr_page_cache o WHERE o.relative_path = n.relative_path AND o.sha256 = n.sha256 AND o.page_number = n.page_number AND list_transform(string_split(o.engine_version, '.'), lambda x: CAST(x AS INT)) >= [5, 3, 4])")
def i_to_recognise(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a version of the reader has still to read."""
    pages = table(spark, d, "ocr_page_cache")
    return ingest.to_recognise(pages.select("row_id", "relative_path", "sha256", "page_number"), pages, "5.3.4").select("row_id")


@query("SELECT row_id, CASE WHEN status = 'no_text' THEN 'again' ELSE status END AS status FROM ocr_page_cache WHERE status <> 'below_threshold' UNION ALL SELECT row_id, 'again' FROM ocr_page_cache WHERE status = 'below_threshold'")
def i_retried(spark: SparkSession, d: str) -> DataFrame:
    """A batch of pages, those that failed replaced by what a retry of each gave."""
    pages = table(spark, d, "ocr_page_cache")
    results = pages.select("row_id", "status", F.when(F.col("status") != "recognised", F.col("status")).alias("error"))
    return ingest.retried(results, pages.select("row_id", F.lit("again").alias("status"), F.lit(None).cast("string").alias("error")), "row_id").select("row_id", "status")


@query("WITH e AS (SELECT event_type, event_id, floor(epoch(ts)) AS t FROM events), w AS (SELECT event_type, event_id, t, min(t) OVER x AS t0, max(event_id) OVER x - min(event_id) OVER x AS n FROM e WINDOW x AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)) SELECT event_type, event_id, round(CASE WHEN t > t0 THEN n / (t - t0) END, 6) AS rate FROM w")
def i_progress(spark: SparkSession, d: str) -> DataFrame:
    """How fast jobs go over their last ten minutes, at each of their samples."""
    e = table(spark, d, "events").select("event_type", "event_id", F.struct("ts", "event_id").alias("k"), F.date_trunc("second", "ts").alias("at"))
    rates = ingest.progress(e.select("event_type", F.col("at"), "event_id").withColumn("done", F.col("event_id")), "event_type", "at", "done", 600)
    return rates.join(e.select("event_type", "at", "event_id"), ["event_type", "at"]).select("event_type", "event_id", F.round("rate", 6).alias("rate")).distinct()


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour; an extension."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e, "ts").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT source AS key, min(doc_id) AS first_row, count(*) AS n FROM documents GROUP BY 1")
def m_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by first appearance."""
    return sinks.first_appearance_groups(table(spark, d, "documents"), "source", "doc_id")


@query("SELECT c_custkey, 'Dear ' || c_name || ', segment ' || coalesce(c_mktsegment, '') || '.' AS letter FROM customer")
def m_letters(spark: SparkSession, d: str) -> DataFrame:
    """A letter for each customer."""
    return sinks.fill("Dear {{name}}, segment «segment».", table(spark, d, "customer"), {"name": "c_name", "segment": "c_mktsegment"}).select("c_custkey", "letter")


@query()
def r_captions(spark: SparkSession, d: str) -> DataFrame:
    """Meeting transcripts as speakers' lines."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: readers.read_captions(t.encode())[0])

    return table(spark, d, "documents").where(F.startswith("text", F.lit("WEBVTT"))).select("doc_id", read("text").alias("text"))

@query("SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last FROM embeddings")
def q_vector_decode(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as stored, little-endian single-precision bytes, decoded again."""

    @F.pandas_udf("binary")
    def stored(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, "<f4").tobytes())

    out = table(spark, d, "embeddings").select("vec_id", search.decoded(stored("embedding")).alias("v"))
    return out.select("vec_id", F.size("v").alias("n"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.element_at("v", -1).cast("double"), 6).alias("last"))


@query("SELECT n_name AS key, count(*) AS lines FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def m_written(spark: SparkSession, d: str) -> DataFrame:
    """Letters written to the shared folder, one folder a nation, and read again."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = f"{shared_dir(spark)}/lectern_letters_{uuid.uuid4().hex}"
    sinks.write_letters(sinks.fill("Dear {{name}}.", c, {"name": "c_name"}), "n_name", path)
    return spark.read.text(path).groupBy(F.col("n_name").alias("key")).agg(F.count("*").alias("lines"))


@query(SQL["q_bm25"])
def q_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The best texts for two words, from a stored index."""
    path = f"{shared_dir(spark)}/lectern_index_{uuid.uuid4().hex}"
    index = search.PostingsIndex.build(table(spark, d, "documents"), "doc_id", "text", path)
    return index.bm25("doc_id", ["scanner", "genou"]).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "doc_id").limit(20)


@query(SQL["q_bm25"].replace("WHERE a > 0 OR b > 0)", "WHERE (a > 0 OR b > 0) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr'))"))
def q_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The best texts of a scope for two words; statistics stay the whole corpus's."""
    docs = table(spark, d, "documents")
    found = search.bm25(docs, "doc_id", "text", ["scanner", "genou"], docs.where("lang = 'fr'"))
    return found.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "doc_id").limit(20)


@query("WITH s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS t FROM orders GROUP BY 1), q AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS a FROM orders) SELECT strftime(a, '%Y-%m-%d') AS quarter, count(*) AS customers FROM s JOIN q ON f <= CAST(a + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AND t >= a GROUP BY 1")
def j_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose span of orders touches each quarter, by a join of spans."""
    o = table(spark, d, "orders")
    spans = o.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("f"), F.max(F.to_date("o_orderdate")).alias("t"))
    quarters = o.select(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("a")).distinct().withColumn("b", F.date_sub(F.add_months("a", 3), 1))
    met = relational.overlap_join(spans, quarters, "f", "t", "a", "b")
    return met.groupBy(F.date_format("a", "yyyy-MM-dd").alias("quarter")).agg(F.count("*").alias("customers"))

"""Queries of the llm operators over the tables of a directory, and the SQL that checks them where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import chunking, mixing, names, ocr, pii, spans, survivor, tokenize
from lectern.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of noise on pages."""
    return ocr.defects(table(spark, sf_dir, "ocr_page_cache")).select("row_id", "defect").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as continuous paragraphs."""
    return ocr.repaired(table(spark, sf_dir, "ocr_page_cache"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of personal information on pages."""
    return pii.mentions(table(spark, sf_dir, "ocr_page_cache")).select("row_id", "kind", "found").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with placeholders."""
    return pii.redact(table(spark, sf_dir, "ocr_page_cache"))


def p3_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What disclosure removes and keeps of possible names, by their form."""
    return pii.decided(table(spark, sf_dir, "ocr_page_cache"))


FACT = ["domain", "path", "kind", "detail"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return names.pairs(table(spark, sf_dir, "file_profile_entities"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings by cluster."""
    return names.clusters(table(spark, sf_dir, "file_profile_entities"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that had to be cut."""
    return chunking.oversized(table(spark, sf_dir, "ocr_page_cache"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in pieces."""
    return chunking.pieces(table(spark, sf_dir, "ocr_page_cache"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving rows of facts that have several, by the order of preference alone."""
    rows, order, _ = survivor.profile_facts(table(spark, sf_dir, "file_profile_fields"), table(spark, sf_dir, "source_trust"))
    return survivor.survivors(rows, FACT, "value", order, "row_id").where("n > 1").select("row_id")


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value each fact's records agree on by weight, and the record closest to it."""
    rows, order, weight = survivor.profile_facts(table(spark, sf_dir, "file_profile_fields"), table(spark, sf_dir, "source_trust"))
    return survivor.survivors(rows, FACT, "value", order, "row_id", weight, vote="weight")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the corpus by the table of targets."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixture reaches."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a span of 300 code points."""
    return spans.pairs(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in another one too."""
    return spans.shares(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_decided": p3_decided,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_consensus": p6_consensus,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

#: Where SQL says what a query must give; the other operators are held against brute force in tests.
SQL: dict[str, str] = {
    "p5_found": "SELECT row_id FROM ocr_page_cache WHERE length(text) > 1200",
    "p6_found": r"""
        WITH f AS (
            SELECT *, nfc_normalize(lower(regexp_replace(regexp_replace(trim(relative_path), '[\\/]+', '/', 'g'), '^(\./)+', ''))) AS path,
                   regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS s,
                   trim(regexp_replace(lower(value), '\s+', ' ', 'g')) AS v
            FROM file_profile_fields WHERE kind IN ('metadata', 'role_surface')),
        r AS (
            SELECT f.row_id, count(*) OVER (PARTITION BY domain, path, kind, detail) AS n,
                   row_number() OVER (PARTITION BY domain, path, kind, detail ORDER BY
                       CASE WHEN v IS NULL OR NOT regexp_matches(v, '[\p{L}\p{N}]') OR regexp_matches(v, '(\.\.+|…)\s*$') OR v IN (STAND_INS)
                            THEN 1 ELSE 0 END,
                       coalesce(chosen, 0) DESC, confidence DESC NULLS LAST, trust_rank ASC NULLS LAST, recorded_at DESC NULLS LAST, f.row_id) AS k
            FROM f LEFT JOIN source_trust t ON f.s = t.source)
        SELECT row_id FROM r WHERE n > 1 AND k = 1""".replace("STAND_INS", ", ".join(f"'{x}'" for x in survivor.STAND_INS)),
}

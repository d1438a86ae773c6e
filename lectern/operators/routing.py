"""Questions about the folder: what is asked, and the answers from profiles, passages and inventories.

A question is read on the driver, as it is one short text; every answer is a DataFrame over whole tables.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold, words_of

#: Files an answer lists; passages shown a file; words up to which a question may continue the one before.
LISTED, PASSAGES, SHORT = 50, 20, 8
# Words that name formats, and words that ask about the inventory, in French and English.
FORMATS = {"pdf": "pdf", "word": "docx", "docx": "docx", "excel": "xlsx", "xlsx": "xlsx", "csv": "csv", "eml": "eml", "mail": "eml", "txt": "txt", "jpg": "jpg", "image": "jpg"}
_INVENTORY = r"\b(combien de (?:fichiers|documents|dossiers)|how many (?:files|documents|folders)|quels dossiers|which folders|illisibles|unreadable|liste des fichiers|list (?:the )?files)\b"
_SET = r"\b(?:quels?|quelles?|which|what)\s+(?:fichiers?|documents?|courriers?|files?|letters?)\b.*?\b(?:parlent? de|mentionnent?|contiennent|concernent|mention|talk about|contain)\s+(.+?)\s*\??$"
_RANK = r"\b(dernier|derniers|derniere|dernieres|latest|most recent|plus recent|plus ancien|premier|earliest|oldest)\b"
_EACH = r"\b(chaque|pour chacun|each|every|par document|per document)\b"


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


@dataclass(frozen=True)
class Route:
    """kind: file, set, rank, inventory, per_document or global; subject: what it is about."""

    kind: str
    subject: str = ""


def route(question: str) -> Route:
    """The way a question about the folder goes: a named file first, then sets, ranks, the inventory, each document, all."""
    q = _plain(question).strip()
    named = re.search(r"[\w./-]+\.(?:pdf|docx|xlsx|csv|eml|txt|jpg|vtt|odt|rtf)\b", question)
    if named:
        return Route("file", named.group())
    found = re.search(_SET, q)
    if found:
        return Route("set", re.sub(r"^(?:le |la |les |l'|du |de la |des |the )", "", found.group(1)))
    if re.search(_INVENTORY, q):
        return Route("inventory", q)
    if re.search(_RANK, q):
        return Route("rank", "earliest" if re.search(r"ancien|premier|earliest|oldest", q) else "latest")
    return Route("per_document" if re.search(_EACH, q) else "global")


def follow_up(question: str, before: str | None) -> str:
    """A short question with the one before in front of it."""
    return f"{before} {question}" if before and len(question.split()) <= SHORT else question


@dataclass(frozen=True)
class Typed:
    """What a search box holds: formats, a date or its start, and the remaining words."""

    formats: list[str] = field(default_factory=list)
    date: str | None = None
    words: list[str] = field(default_factory=list)


def read_typed(text: str) -> Typed:
    """Words of formats, a year, month or day (2024, 2024-03, 03/2024, 05.03.2024), and the rest."""
    formats, date, words = [], None, []
    for token in _plain(text).split():
        day, month = re.fullmatch(r"(\d{1,2})[./](\d{1,2})[./](\d{4})", token), re.fullmatch(r"(\d{1,2})[./](\d{4})", token)
        if token in FORMATS:
            formats.append(FORMATS[token])
        elif re.fullmatch(r"(?:19|20)\d\d(?:-\d\d(?:-\d\d)?)?", token) and date is None:
            date = token
        elif day and date is None:
            date = f"{day[3]}-{int(day[2]):02d}-{int(day[1]):02d}"
        elif month and date is None:
            date = f"{month[2]}-{int(month[1]):02d}"
        else:
            words.extend(re.findall(r"[^\W_]+", token))
    return Typed(formats, date, words)


def typed_filter(typed: Typed) -> Column:
    """Files (format, document_date, relative_path) a search box's text means; never null."""
    test = F.lit(True)
    if typed.formats:
        test = test & F.col("format").isin(typed.formats)
    if typed.date:
        test = test & F.startswith("document_date", F.lit(typed.date))
    stem = words_of(F.regexp_extract("relative_path", r"([^/]*)$", 1))
    for w in typed.words:
        test = test & F.exists(stem, _starts(w))
    return F.coalesce(test, F.lit(False))


def _starts(word: str) -> Callable[[Column], Column]:
    return lambda x: F.startswith(x, F.lit(word))


def set_search(pages: DataFrame, path: str, text: str, words: list[str]) -> DataFrame:
    """Files with pages that hold all words: (path, passages), the most first, LISTED of them, with the total of files."""
    own = words_of(F.col(text))
    test = F.lit(True)
    for w in words:
        test = test & F.array_contains(own, w)
    found = pages.where(test).groupBy(path).agg(F.count("*").alias("passages"))
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy(F.desc("passages"), path).limit(LISTED).join(F.broadcast(total))


def first_passages(pages: DataFrame, path: str, key: str, place: list[str], test: Column, most: int = PASSAGES) -> DataFrame:
    """Each file's first passages that pass a test, at most so many, with how many it has: (path, key, place, total)."""
    from pyspark.sql import Window

    hits = pages.where(test).select(path, key, *place)
    totals = hits.groupBy(path).agg(F.count("*").alias("total"))
    w = Window.partitionBy(path).orderBy(*place, key)
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).join(totals, path).select(path, key, "nth", "total")


def both_domains(files: DataFrame, test: Column) -> DataFrame:
    """Files of either domain that pass a test, each with its domain's total."""
    found = files.where(test).select("domain", "relative_path")
    return found.join(found.groupBy("domain").agg(F.count("*").alias("total")), "domain")


def inventory(files: DataFrame) -> DataFrame:
    """The folder in numbers: (what, value, n) for all files, states, formats, kinds and the missing kind, in one pass."""
    each = F.array(
        F.struct(F.lit("files").alias("what"), F.lit("").alias("value")),
        F.struct(F.lit("state").alias("what"), F.col("state").alias("value")),
        F.struct(F.lit("format").alias("what"), F.col("format").alias("value")),
        F.struct(F.lit("kind").alias("what"), F.coalesce("business_type", F.lit("-")).alias("value")),
    )
    return files.select(F.explode(each).alias("x")).select("x.*").where("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))


def families(files: DataFrame) -> DataFrame:
    """Per domain: files, analysed, unreadable, empty and dated ones."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    return files.groupBy("domain").agg(F.count("*").alias("files"), is_("analysed").alias("analysed"), is_("unreadable").alias("unreadable"), is_("empty").alias("empty"), F.count("document_date").alias("dated"))


def one_per_content(files: DataFrame) -> DataFrame:
    """One row a physical file: its first path (documents before data) and all its domains and how many paths it has."""
    order = F.struct((F.col("domain") != "documents").alias("last"), F.col("relative_path"))
    return files.where("content_id is not null").groupBy("content_id").agg(F.min_by("relative_path", order).alias("relative_path"), F.array_sort(F.collect_set("domain")).alias("domains"), F.count("*").alias("paths"))


def with_profile(listing: DataFrame, profiles: DataFrame, path: str = "relative_path") -> DataFrame:
    """Listed files with their profile's title, type and state; files without a profile keep nulls."""
    return listing.join(profiles.select(path, "domain", "title", "business_type", "state"), path, "left")


def scope(selected: DataFrame, present: DataFrame) -> DataFrame:
    """A selection (relative_path, content_id) against what is there: current, outdated (other content) or gone."""
    now = present.select("relative_path", F.col("content_id").alias("_now"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "gone").when(F.col("_now").eqNullSafe(F.col("content_id")), "current").otherwise("outdated")
    return selected.join(now, "relative_path", "left").select("relative_path", state.alias("status"))


def sorted_names(files: DataFrame, n: int) -> DataFrame:
    """The first n files by name as people sort: case and accents ignored, numbers by value, then path."""
    name = fold(F.regexp_extract("relative_path", r"([^/]*)$", 1))
    pieces = F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return files.withColumn("_key", F.array_join(pieces, "")).orderBy("_key", "relative_path", "domain").limit(n).drop("_key")


def explorer(files: DataFrame, domains: list[str] | None = None, formats: list[str] | None = None, states: list[str] | None = None, folder: str | None = None, types: list[str] | None = None, years: list[str] | None = None, ticked: DataFrame | None = None) -> DataFrame:
    """Files under all filters that are set; ticked files are a table, so a join."""
    out = files
    for column, values in (("domain", domains), ("format", formats), ("state", states), ("business_type", types)):
        if values:
            out = out.where(F.col(column).isin(values))
    if years:
        out = out.where(F.substring("document_date", 1, 4).isin(years))
    if folder:
        out = out.where(F.startswith("relative_path", F.lit(folder.rstrip("/") + "/")))
    return out if ticked is None else out.join(ticked.select("relative_path").distinct(), "relative_path", "left_semi")


def user_types(files: DataFrame, rules: str) -> DataFrame:
    """Files with the type user rules give them: (profile_id, user_type). rules: JSON list of {"type", and any of "path"
    (a folder), "words" (all in the title), "format"}; the first rule that fits counts, others leave null."""
    out: Column = F.lit(None).cast("string")
    for rule in reversed(json.loads(rules)):
        if set(rule) - {"type", "path", "words", "format"} or "type" not in rule:
            raise ValueError(f"unknown rule {rule}")
        test = F.lit(True)
        if "path" in rule:
            test = test & F.startswith("relative_path", F.lit(rule["path"].rstrip("/") + "/"))
        if "format" in rule:
            test = test & (F.col("format") == rule["format"])
        for w in rule.get("words", []):
            test = test & F.array_contains(words_of(F.col("title")), _plain(w))
        out = F.when(F.coalesce(test, F.lit(False)), rule["type"]).otherwise(out)
    return files.select("profile_id", out.alias("user_type"))


def value_words(df: DataFrame, columns: list[str]) -> DataFrame:
    """Words of the cells of columns, with the values they stand in: (column, word, value), each once."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return cells.where("value is not null").distinct().select("column", F.explode(F.array_distinct(words_of(F.col("value")))).alias("word"), "value")


def row_lookup(df: DataFrame, token: str, columns: list[str]) -> DataFrame:
    """Rows in which a cell, folded, is a token of a question."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(fold(F.trim(F.col(c).cast("string"))) == _plain(token), F.lit(False))
    return df.where(test)


def canonical(df: DataFrame, column: str, asked: str) -> list[str]:
    """Values of a column as written that a plan's value means, folded equal; at most a few hundred writings are returned."""
    rows = df.select(F.col(column).cast("string").alias("v")).where(fold(F.col("v")) == _plain(asked)).distinct().orderBy("v").limit(300).collect()
    return [r["v"] for r in rows]


def widened(narrow: DataFrame, wide: DataFrame, score: str, least: float = 0.65) -> DataFrame:
    """A reduced search's hits, or the whole scope's where it found nothing or nothing near enough."""
    best = narrow.agg(F.coalesce(F.max(score), F.lit(-1.0)).alias("_best"))  # one row
    kept = narrow.join(F.broadcast(best)).where(F.col("_best") >= least).drop("_best")
    return kept.unionByName(wide.join(F.broadcast(best)).where(F.col("_best") < least).drop("_best"))

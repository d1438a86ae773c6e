"""Finding files: match channels with reasons, filters, coverage, ranking by date, folders."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import split_date_prefix
from lectern.functions.text import fold, words_of

#: What a channel's match weighs, and how many files a page shows.
WEIGHTS = {"name": 5, "profile": 4, "identifier": 6, "date": 3, "passage": 1}
PAGE, MOST = 50, 100_000


def date_within(value: Column, bound: Column) -> Column:
    """Whether an ISO date, maybe of month or year precision, lies in the period a bound (YYYY, YYYY-MM or a day)
    names; a value coarser than the bound doesn't."""
    return F.coalesce(F.startswith(value, bound), F.lit(False))


def spans_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two closed spans share a day."""
    return (a_from <= b_to) & (a_to >= b_from)


def passes(formats: list[str] | None = None, states: list[str] | None = None, types: list[str] | None = None, folder: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Filters of the finder: values of a facet are alternatives, facets must all hold, a folder is a prefix."""
    tests = [F.lit(True)]
    for column, values in (("format", formats), ("state", states), ("business_type", types)):
        if values:
            tests.append(F.col(column).isin(values))
    if folder:
        tests.append(F.startswith(F.col("relative_path"), F.lit(folder.rstrip("/") + "/")))
    if since:
        tests.append(F.col("document_date") >= since)
    if until:
        tests.append(F.substring("document_date", 1, len(until)) <= until)
    return F.coalesce(reduce(and_, tests), F.lit(False))


def channels(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Files any channel matched, with their reasons in order and the greatest weight."""
    tagged = [df.select(key, F.lit(name).alias("reason"), F.lit(WEIGHTS[name]).alias("weight")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("weight").alias("weight"))


def by_name(files: DataFrame, key: str, path: str, words: list[str], last_is_prefix: bool = True) -> DataFrame:
    """Files whose name has all the words; the last may be only begun."""
    stem = words_of(F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]*)?$", 1))
    exact = words[:-1] if last_is_prefix else words
    tests = [F.array_contains(stem, w) for w in exact]
    if last_is_prefix:
        tests.append(F.exists(stem, lambda x: F.startswith(x, F.lit(words[-1]))))
    return files.where(reduce(and_, tests)).select(key)


def coverage(files: DataFrame) -> DataFrame:
    """One row: files in scope, searched, unreadable, empty, not analysed."""
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("state") == "analysed").alias("searched"),
        F.count_if(F.col("state") == "unreadable").alias("unreadable"),
        F.count_if(F.col("state") == "empty").alias("empty"),
        F.count_if(F.col("business_type").isNull()).alias("untyped"),
    )


def folders(files: DataFrame, path: str) -> DataFrame:
    """Every folder, whatever its depth, with the files under it: (folder, depth, files)."""
    parts = F.slice(F.split(F.col(path), "/"), F.lit(1), F.size(F.split(F.col(path), "/")) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    rows = files.where(F.size(parts) > 0).select(F.explode(above).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files")).select("folder", F.size(F.split("folder", "/")).alias("depth"), "files")


def dated(files: DataFrame) -> DataFrame:
    """Files with the date they rank by and its basis: the document's, else the name's, else when profiled."""
    stem = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    named, _ = split_date_prefix(stem)
    return files.withColumn("rank_date", F.coalesce("document_date", named, F.date_format("profiled_at", "yyyy-MM-dd"))).withColumn(
        "basis", F.when(F.col("document_date").isNotNull(), "document").when(named.isNotNull(), "name").otherwise("profiled")
    )


def latest(files: DataFrame, n: int = 5, earliest: bool = False) -> DataFrame:
    """The n latest (or earliest) files by the date they rank by."""
    order = F.asc("rank_date") if earliest else F.desc("rank_date")
    return dated(files).orderBy(order, "relative_path").limit(n)


def resolve_reference(files: DataFrame, path: str, query: str) -> DataFrame:
    """Files a reference may mean, by the first reason that has any: path, name, name in any case, stem, a word
    of the stem, a folder. Rows (path, reason); several rows mean the reference is ambiguous, none that it isn't found."""
    name, low = F.regexp_extract(F.col(path), r"([^/]*)$", 1), query.lower()
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    reason = (
        F.when(F.col(path) == query, 0)
        .when(name == query, 1)
        .when(F.lower(name) == low, 2)
        .when(F.lower(stem) == low, 3)
        .when(F.array_contains(words_of(stem), low), 4)
        .when(fold(F.regexp_extract(F.col(path), r"([^/]*)/[^/]*$", 1)) == low, 5)
    )
    hits = files.select(F.col(path), reason.alias("r")).where("r is not null")
    names = F.array(*map(F.lit, ["path", "name", "name_any_case", "stem", "stem_word", "folder"]))
    return hits.join(F.broadcast(hits.agg(F.min("r").alias("r"))), "r").select(path, F.element_at(names, F.col("r") + 1).alias("reason"))

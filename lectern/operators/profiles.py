"""Profiles of files: fields chosen with their evidence, header lines, dates, columns; and what names resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import parse_date
from lectern.functions.phonetic import phonetic_key
from lectern.functions.text import bounded_damerau, fold, words_of
from lectern.operators.knowledge import name_key, token_set_key
from lectern.operators.relational import best_per

#: Lines of a text that are its header.
HEADER = 12


def chosen_fields(fields: DataFrame, details: list[str]) -> DataFrame:
    """A file's profile: for each of details the surest value with its source as evidence: (domain, relative_path, detail,
    value, source). Blank values are no evidence; equal confidence goes to the later record, then to the lesser row."""
    rows = fields.where((F.col("kind") == "metadata") & F.col("detail").isin(details) & (F.trim("value") != ""))
    order = [F.desc_nulls_last("confidence"), F.desc_nulls_last("recorded_at"), F.asc("row_id")]
    return best_per(rows, ["domain", "relative_path", "detail"], order).select("domain", "relative_path", "detail", "value", "source")


def header_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Labelled lines among a text's first ones: (key, line, label folded, value)."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.slice(F.split(text, "\r?\n"), 1, HEADER)).alias("line", "t"))
    label, value = (F.regexp_extract("t", r"^\s*([\p{L}][\p{L} .'’-]{1,30}?)\s*:\s+(\S.*)$", i) for i in (1, 2))
    return lines.select(key, "line", fold(label).alias("label"), F.trim(value).alias("value")).where("label <> ''")


def date_of_evidence(evidence: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """The date each key's best kind of evidence (least rank) agrees on; null where it states several: (keys, date, rank)."""
    dated = evidence.select(*keys, rank, parse_date(F.col(value)).alias("date")).where("date is not null")
    best = dated.groupBy(*keys).agg(F.min(rank).alias(rank))
    return dated.join(best, [*keys, rank]).groupBy(*keys, rank).agg(F.when(F.countDistinct("date") == 1, F.min("date")).alias("date"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: filled cells, different words in them, and the first and last date they write."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("v")) for c in columns])).alias("x")).select("x.*").where("v <> ''")
    dated = cells.groupBy("column").agg(F.count("*").alias("filled"), F.min(parse_date(F.col("v"))).alias("first_date"), F.max(parse_date(F.col("v"))).alias("last_date"))
    words = cells.select("column", F.explode(words_of(F.col("v"))).alias("w")).distinct().groupBy("column").agg(F.count("*").alias("words"))
    return dated.join(words, "column", "left").na.fill(0, ["words"])


def _initials(name: Column) -> Column:
    """The surname and first letter a name of two words gives, whichever way round: both readings."""
    ws = F.filter(words_of(name), lambda w: w != "")
    return F.when(F.size(ws) == 2, F.array(F.concat(ws[1], F.lit(" "), F.substring(ws[0], 1, 1)), F.concat(ws[0], F.lit(" "), F.substring(ws[1], 1, 1))))


#: The signals of resolution, in the order they are believed.
SIGNALS = ["suppressed", "canonical", "alias", "swapped", "initial", "surname", "fuzzy"]


def resolve_cascade(queries: DataFrame, base: DataFrame, aliases: DataFrame, suppressed: DataFrame, fuzzy: bool = True) -> DataFrame:
    """What each name (name) resolves to among entities (id, name) with aliases (id, alias): (name, id, signal, outcome).

    The first signal with any hit counts: a suppressed name (resolves to nothing), the canonical name, an alias, the same
    words in another order (only possible), a surname with a fitting initial (only possible), a surname alone (only
    possible), one edit in all (only possible). Several entities under a signal are ambiguous. Every signal is an equi-join.
    """
    q = queries.select("name").where("name is not null").distinct()
    hit = lambda df, n: df.select("name", "id", F.lit(n).alias("signal"))
    keyed = q.select("name", name_key(F.col("name")).alias("k"), token_set_key(F.col("name")).alias("t"))
    canonical = base.select("id", name_key(F.col("name")).alias("k"), token_set_key(F.col("name")).alias("t"), "name")
    stopped = hit(keyed.join(suppressed.select(name_key(F.col("name")).alias("k")).distinct(), "k", "left_semi").withColumn("id", F.lit(None).cast("bigint")), 0)
    exact = hit(keyed.join(canonical.select("id", "k"), "k"), 1)
    other = hit(keyed.join(aliases.select("id", name_key(F.col("alias")).alias("k")).distinct(), "k"), 2)
    turned = hit(keyed.join(canonical.select("id", "t"), "t"), 3)
    short = q.select("name", F.explode(_initials(F.col("name"))).alias("i")).where(F.col("name").rlike(r"(^|\s)\p{Lu}\.(\s|$)"))
    initial = hit(short.join(canonical.select("id", F.explode(_initials(F.col("name"))).alias("i")), "i"), 4)
    lone = keyed.where(~F.contains("k", F.lit(" ")) & (F.col("k") != ""))
    surname = hit(lone.join(canonical.where(F.contains("k", F.lit(" "))).select("id", F.explode(F.split("k", " ")).alias("k")), "k"), 5)
    hits = [stopped, exact, other, turned, initial, surname]
    if fuzzy:
        # one edit leaves a common form among a word and itself less one letter
        less = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
        a = keyed.where(F.length("t") >= 4).select("name", "t", F.explode(less(F.col("t"))).alias("f"))
        b = canonical.where(F.length("t") >= 4).select("id", F.col("t").alias("u"), F.explode(less(F.col("t"))).alias("f"))
        near = a.join(b, "f").select("name", "id", "t", "u").distinct()
        hits.append(hit(near.where(bounded_damerau(F.col("t"), F.col("u"), 1).isNotNull()), 6))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    best = every.groupBy("name").agg(F.min("signal").alias("signal"))
    counted = every.join(best, ["name", "signal"]).groupBy("name", "signal").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    outcome = F.when(F.col("signal") == 0, "suppressed").when(F.col("n") > 1, "ambiguous").when(F.col("signal") <= 2, "resolved").when(F.col("n") == 1, "possible").otherwise("unknown")
    return q.join(counted, "name", "left").select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("signal").isNull(), "none").otherwise(F.get(F.array(*map(F.lit, SIGNALS)), F.coalesce("signal", F.lit(0)))).alias("signal"), outcome.alias("outcome"))


def apply_delta(mentions: DataFrame, delta: DataFrame, source: str) -> DataFrame:
    """Mentions with those of one source replaced by the source's new ones, each (file, surface, locator) once, the surest."""
    new = best_per(delta, ["domain", "relative_path", "surface", "locator"], [F.desc_nulls_last("confidence"), F.asc("row_id")])
    return mentions.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new.select(mentions.columns))


def suggestions(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """Questions a sheet can answer: for each column its n commonest values, weighed by how many rows they have."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("value")) for c in columns])).alias("x")).select("x.*").where("value <> ''")
    best = best_per(cells.groupBy("column", "value").agg(F.count("*").alias("weight")), ["column"], [F.desc("weight"), F.asc("value")], n)
    return best.select(F.concat(F.lit("Combien de lignes avec "), "column", F.lit(" = "), "value", F.lit(" ?")).alias("question"), "weight")


def sound_alikes(heard: DataFrame, known: DataFrame, word: str) -> DataFrame:
    """Heard words that aren't known with known ones of the same phonetic key: (heard, meant, edits), the nearest first.
    Words are distinct, and each is encoded once."""
    strange = heard.select(word).distinct().join(known.select(word), word, "left_anti").select(F.col(word).alias("heard"), phonetic_key(F.col(word)).alias("k"))
    own = known.select(word).distinct().select(F.col(word).alias("meant"), phonetic_key(F.col(word)).alias("k"))
    return strange.join(own, "k").where("k <> ''").select("heard", "meant", F.levenshtein("heard", "meant").alias("edits")).orderBy("edits", "heard", "meant")

"""Scalar text functions, as JVM column expressions wherever Spark can say them.

Folding replaces letters with marks by bare ones through one translate table built from Unicode's own
decompositions of the Latin blocks, so it stays within whole-stage code generation.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _marks() -> tuple[str, str]:
    """Latin letters with marks and what they are without, lower case; combining marks themselves go."""
    letters, plain = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).lower()
        if len(bare) == 1 and bare != c:
            letters.append(c)
            plain.append(bare)
    gone = "".join(map(chr, range(0x300, 0x370)))
    return "".join(letters) + gone, "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without marks: whole-cell and substring comparisons ignore case and accents."""
    letters, plain = _marks()
    return F.translate(F.lower(c), letters, plain)


def fold_word(c: Column) -> Column:
    """Folded, ligatures spelt out, letters and digits only."""
    wide = F.replace(F.replace(F.lower(c), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(fold(wide), r"[^\p{L}\p{N}]+", "")


def sound_form(c: Column) -> Column:
    """Folded for sound: a c with cedilla is an s."""
    return fold(F.replace(F.lower(c), F.lit("ç"), F.lit("s")))


def words_of(c: Column) -> Column:
    """Folded words of a name or question, in order."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spaced_words(c: Column) -> Column:
    """A column name as words: camel case, underscores and dashes become spaces."""
    spaced = F.regexp_replace(c, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    return F.trim(fold(F.regexp_replace(spaced, r"[_\-.\s]+", " ")))


def normalize_identifier(c: Column) -> Column:
    """An identifier without separators, in capitals."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def escape_like(c: Column) -> Column:
    r"""Text to stand literally in a LIKE pattern with \ as its escape."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def is_plural(word: Column, name: Column) -> Column:
    """Whether word is name or a regular plural of it (s, es, x)."""
    return (word == name) | (word == F.concat(name, F.lit("s"))) | (word == F.concat(name, F.lit("es"))) | (word == F.concat(name, F.lit("x")))


def sanitize_file_name(c: Column) -> Column:
    """A safe file name: folded to ASCII, other characters one dash, none at either end, never empty."""
    dashed = F.regexp_replace(fold(c), r"[^a-z0-9._]+", "-")
    clean = F.regexp_replace(dashed, r"^[-.]+|[-.]+$", "")
    return F.when(clean == "", F.lit("file")).otherwise(clean)


def clean_inline(c: Column) -> Column:
    """Markdown's inline marks removed: images and links give their text, emphasis and code their content."""
    out = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(\*\*|__)(.+?)\1", "$2")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])([*_])([^*_]+)\1(?![\p{L}\p{N}])", "$2")
    return F.regexp_replace(out, "`([^`]*)`", "$1")


def markdown_blocks(c: Column) -> Column:
    """Blocks of a Markdown text: separated by blank lines, without heading, list and quote marks."""
    blocks = F.split(F.regexp_replace(c, "\r\n?", "\n"), r"\n[ \t]*\n+")
    bare = F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"(?m)^[ \t]*(?:#{1,6}|[-*+>]|\d+[.)])[ \t]+", "")))
    return F.filter(bare, lambda b: b != "")


# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ["M", "MM", "Mme", "Mlle", "Dr", "Dre", "Prof", "Me", "St", "Ste", "av", "env", "cf", "etc", "p", "pp", "réf", "ref", "tél", "no", "n", "art", "vol", "ex", "bd", "fr", "Mr", "Mrs", "Ms", "vs", "e.g", "i.e"]


def split_sentences(c: Column) -> Column:
    """Sentences of a text; a full stop after a known abbreviation, an initial or a number ends none."""
    keep = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    held = F.regexp_replace(c, rf"(?<![\p{{L}}])({keep}|\p{{Lu}}|\d)\.(?=\s)", "$1" + chr(1))
    parts = F.split(F.regexp_replace(held, r"([.!?…]+[»\"')\]]*)\s+", "$1" + chr(2)), chr(2))
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit(chr(1)), F.lit(".")))), lambda s: s != "")


def match_terms(query: Column, least: int = 4) -> Column:
    """Terms a full-text query asks for: folded words of at least so many letters, once each."""
    return F.array_distinct(F.filter(words_of(query), lambda w: F.length(w) >= least))


def excerpt(text: Column, term: Column, words: int = 28, before: int = 8) -> Column:
    """So many words of a text around the first one that starts with a folded term."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(parts, lambda w: F.startswith(fold_word(w), term)), True)
    start = F.greatest(F.lit(1), at.cast("int") - before)
    return F.when(at > 0, F.concat_ws(" ", F.slice(parts, start, words)))


# Placeholders in templates: {{name}}, «name», [name].
_FIELD = r"\{\{\s*([^{}\n]{1,60}?)\s*\}\}|«\s*([^«»\n]{1,60}?)\s*»|\[\s*([^\[\]\n]{1,60}?)\s*\]"


def placeholders(c: Column) -> Column:
    """Names of the fields a template asks for, once each, in order; names of digits alone are none."""
    found = F.regexp_extract_all(c, F.lit(_FIELD), F.lit(0))
    names = F.transform(found, lambda f: F.trim(F.regexp_replace(f, r"^(?:\{\{|«|\[)\s*|\s*(?:\}\}|»|\])$", "")))
    return F.array_distinct(F.filter(names, lambda n: ~n.rlike(r"^\d+$") & (n != "")))


def citations_out_of_range(answer: Column, sources: Column) -> Column:
    """Citations [n] of an answer that name no source, ascending."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n < 1) | (n > sources))))


def osa_distance(a: str, b: str, most: int) -> int | None:
    """Edits between words, a swap of neighbours counting one; None beyond most."""
    if abs(len(a) - len(b)) > most:
        return None
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def bounded_damerau(a: Column, b: Column, most: int) -> Column:
    """osa_distance as a column, null beyond most. A cheap JVM bound on lengths spares most rows the call."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(p, q, most) if isinstance(p, str) and isinstance(q, str) else None for p, q in zip(x, y, strict=True)], dtype="Int32")

    near = F.abs(F.length(a) - F.length(b)) <= most
    return F.when(near, run(F.when(near, a), F.when(near, b)))


def near_pairs(words: Column, df: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b, edits) of different words of a column within so many edits, a before b.

    Words that near share a form that so many deletions at most make of either (symmetric deletion), so they meet in an
    equi-join; the distance is computed for those that meet.
    """
    distinct = df.select(words.alias("w")).where("w is not null and w <> ''").distinct()

    @F.pandas_udf("array<string>")
    def deletions(ws: pd.Series) -> pd.Series:
        def of(w: str) -> list[str]:
            out = layer = {w}
            for _ in range(most):
                layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
                out = out | layer
            return sorted(out)

        return ws.map(of)

    forms = distinct.select("w", F.explode(deletions(F.col("w"))).alias("form"))
    met = forms.select(F.col("w").alias("a"), "form").join(forms.select(F.col("w").alias("b"), "form"), "form").where("a < b").select("a", "b").distinct()
    return met.withColumn("edits", bounded_damerau(F.col("a"), F.col("b"), most)).where("edits is not null")

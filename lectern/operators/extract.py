"""What names and identifiers texts and tables hold: scans by scheme, longest matches, columns, aliases, relations.

Matching a dictionary against texts is an equi-join of runs of words, each as one string, so the dictionary may be of any
size; texts leave their scan as runs of at most LONGEST words.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold, words_of
from lectern.operators.relational import best_per
from lectern.session import checkpointed, spread

#: Words of the longest run a dictionary is asked for.
LONGEST = 5
#: Share of a column's filled cells that must look like a kind, and rows kept as samples of a value.
PERSON_SHARE, IDENTIFIER_SHARE, TEXT_SHARE, SAMPLES = 0.70, 0.80, 0.70, 3


@dataclass(frozen=True)
class Pack:
    """A lexicon as data: identifier schemes with their pattern and layout of digits, header words by meaning, and rules
    (subject meaning, object meaning, predicate)."""

    schemes: dict[str, str]
    layouts: dict[str, list[int]]
    headers: dict[str, list[str]]
    relations: list[tuple[str, str, str]]


def load_pack(text: str) -> Pack:
    """A pack from JSON; unknown keys, patterns that don't compile and layouts without a scheme are refused."""
    raw = json.loads(text)
    if set(raw) - {"schemes", "layouts", "headers", "relations"}:
        raise ValueError(f"unknown keys {sorted(set(raw) - {'schemes', 'layouts', 'headers', 'relations'})}")
    for pattern in raw.get("schemes", {}).values():
        re.compile(pattern)
    if set(raw.get("layouts", {})) - set(raw.get("schemes", {})):
        raise ValueError("a layout needs a scheme")
    return Pack(raw.get("schemes", {}), raw.get("layouts", {}), raw.get("headers", {}), [tuple(r) for r in raw.get("relations", [])])


def scan_identifiers(df: DataFrame, key: str, text: str, schemes: dict[str, str]) -> DataFrame:
    """Identifiers in texts: (key, scheme, written, compact), each different writing of a text once."""

    def of(scheme: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.struct(F.lit(scheme).alias("scheme"), w.alias("written")))

    found = [of(s, p) for s, p in schemes.items()]
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.concat(*found))).alias("x"))
    return rows.select(key, "x.scheme", "x.written", F.upper(F.regexp_replace("x.written", "[^A-Za-z0-9]", "")).alias("compact"))


def grouped(compact: Column, layout: list[int], separator: str = ".") -> Column:
    """A compact identifier written in groups; null where its length isn't the layout's."""
    parts, at = [], 1
    for n in layout:
        parts.append(F.substring(compact, at, n))
        at += n
    return F.when(F.length(compact) == sum(layout), F.concat_ws(separator, *parts))


def identifier_forms(compact: Column, layout: list[int]) -> Column:
    """All ways an identifier may be written: compact, and in groups by point, blank and dash."""
    return F.filter(F.array(compact, *[grouped(compact, layout, s) for s in (".", " ", "-")]), lambda f: f.isNotNull())


def runs(df: DataFrame, key: str, text: str, longest: int = LONGEST) -> DataFrame:
    """Runs of 1 to longest folded words of texts: (key, at, size, run), at from 1."""
    words = df.where(F.col(text).isNotNull()).select(key, words_of(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    at = words.select(key, "ws", F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("at"))
    sized = at.select(key, "ws", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("ws") - F.col("at") + 1))).alias("size"))
    return sized.select(key, "at", "size", F.array_join(F.slice("ws", F.col("at"), F.col("size")), " ").alias("run"))


def dictionary(names: DataFrame, name: str, longest: int = LONGEST) -> DataFrame:
    """Entries (run, words) of names: folded words joined, of at most longest words, once each."""
    ws = words_of(F.col(name))
    return names.where(F.col(name).isNotNull()).select(F.array_join(ws, " ").alias("run"), F.size(ws).alias("words")).where((F.col("words") > 0) & (F.col("words") <= longest)).distinct()


def longest_matches(df: DataFrame, key: str, text: str, entries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The longest entry at each place of a text where any starts: (key, at, size, run)."""
    hits = runs(df, key, text, longest).join(entries.select("run"), "run", "left_semi")
    return hits.groupBy(key, "at").agg(F.max(F.struct("size", "run")).alias("x")).select(key, "at", "x.size", "x.run")


def apart(matches: DataFrame, key: str) -> DataFrame:
    """Matches that no longer one, nor an equally long earlier one, overlaps: runs longest first, as a question is read."""
    a = matches.select(key, F.col("at").alias("a_at"), F.col("size").alias("a_size"), F.col("run").alias("a_run"))
    # only a text's own matches meet, at most LONGEST to either side of each
    near = a.select("*", F.explode(F.sequence(F.col("a_at") - LONGEST + 1, F.col("a_at") + F.col("a_size") - 1)).alias("at"))
    over = near.join(matches.select(key, "at", "size"), [key, "at"]).where(
        (F.col("at") + F.col("size") > F.col("a_at")) & ((F.col("size") > F.col("a_size")) | ((F.col("size") == F.col("a_size")) & (F.col("at") < F.col("a_at"))))
    )
    return matches.join(over.select(key, F.col("a_at").alias("at")), [key, "at"], "left_anti")


def strip_known(df: DataFrame, key: str, text: str, entries: DataFrame, mark: str = "[NOM]") -> DataFrame:
    """Texts as folded words with known names under a mark: (key, text); null texts stay null.

    key is unique. A text has at most as many matches as words, so the list is bounded by the text it joins.
    """
    found = apart(longest_matches(df, key, text, entries), key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("marks"))
    rows = df.select(key, words_of(F.col(text)).alias("ws")).join(found, key, "left")
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))
    marks = F.coalesce("marks", none)
    inside = F.flatten(F.transform(F.map_entries(marks), lambda e: F.sequence(e["key"], e["key"] + e["value"] - 1)))
    kept = F.filter(
        F.transform("ws", lambda w, i: F.when(F.array_contains(F.map_keys(F.col("_m")), (i + 1).cast("int")), F.lit(mark)).when(~F.array_contains(F.col("_in"), (i + 1).cast("int")), w)),
        lambda w: w.isNotNull(),
    )
    return rows.withColumn("_m", marks).withColumn("_in", inside).select(key, F.when(F.col("ws").isNotNull(), F.array_join(kept, " ")).alias("text"))


# Words of a header that tell what a column holds.
MEANINGS = {"person": ["patient", "nom", "medecin", "client", "assure"], "organization": ["caisse", "fournisseur", "assurance", "employeur"], "identifier": ["avs", "numero", "no", "facture", "code"], "date": ["date", "naissance", "jour"], "amount": ["montant", "prix", "total"]}


def meaning(header: Column, meanings: dict[str, list[str]] | None = None) -> Column:
    """What a header's words say a column holds; null where none says anything."""
    words = words_of(header)
    return F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, ws))), F.lit(m)) for m, ws in (meanings or MEANINGS).items()])


def value_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, over all its filled cells: (column, filled, person, identifier, text) as shares.

    A person is two or three capitalised words, an identifier has digits and at most one letter in three signs, a text is
    longer than 40 signs or has more than five words.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in columns])).alias("x")).select("x.*").where("v <> ''")
    person = F.col("v").rlike(r"^(?:(?:Dr|Dre|Mme|M\.|Prof\.)\s+)?\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+){1,2}$")
    digits, letters = F.length(F.regexp_replace("v", r"\D", "")), F.length(F.regexp_replace("v", r"\P{L}", ""))
    identifier = (digits > 0) & (letters * 3 <= F.length("v")) & ~F.col("v").rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$|^\d{4}-\d{2}-\d{2}$")
    text = (F.length("v") > 40) | (F.size(F.split("v", r"\s+")) > 5)
    share = lambda c: F.avg(c.cast("double"))
    return stacked.groupBy("column").agg(F.count("*").alias("filled"), share(person).alias("person"), share(identifier).alias("identifier"), share(text).alias("text"))


def column_semantics(shapes: DataFrame) -> DataFrame:
    """What each column holds, by its header's meaning and the shares of its cells: (column, semantics)."""
    m = meaning(F.col("column"))
    return shapes.select(
        "column",
        F.when((m == "person") & (F.col("person") >= PERSON_SHARE), "person")
        .when((m == "organization") & (F.col("text") < TEXT_SHARE), "organization")
        .when((m == "identifier") & (F.col("identifier") >= IDENTIFIER_SHARE), "identifier")
        .when(m.isin("date", "amount"), m)
        .when(F.col("text") >= TEXT_SHARE, "text")
        .when(m.isNull() & (F.col("filled") >= 5) & (F.col("person") >= 0.90), "person")
        .otherwise("other")
        .alias("semantics"),
    )


def distinct_values(df: DataFrame, column: str, row: str, samples: int = SAMPLES) -> DataFrame:
    """Candidates of a column: (value, n, rows) with the first few rows that hold each. Rows are chosen by repeated
    minima, so no value's rows are gathered."""
    kept = df.select(F.trim(F.col(column)).alias("value"), F.col(row).alias("r")).where("value <> ''")
    out = kept.groupBy("value").agg(F.count("*").alias("n"), F.min("r").alias("r0"))
    for i in range(1, samples):
        later = kept.join(out.select("value", F.col(f"r{i - 1}").alias("last")), "value").where(F.col("r") > F.col("last")).groupBy("value").agg(F.min("r").alias(f"r{i}"))
        out = out.join(later, "value", "left")
    return out.select("value", "n", F.array_compact(F.array(*[f"r{i}" for i in range(samples)])).alias("rows"))


def name_parts(df: DataFrame, given: str, family: str) -> DataFrame:
    """Persons two columns write in parts: (person, n)."""
    kept = df.where((F.trim(F.col(given)) != "") & (F.trim(F.col(family)) != ""))
    return kept.groupBy(F.concat_ws(" ", F.trim(F.col(given)), F.trim(F.col(family))).alias("person")).agg(F.count("*").alias("n"))


def attach_identifiers(df: DataFrame, people: list[Column], identifier: str) -> DataFrame:
    """Identifiers of persons (person, identifier, n), only where exactly one column, or pair of parts, holds people."""
    if len(people) != 1:
        return df.sparkSession.createDataFrame([], "person string, identifier string, n bigint")
    compact = F.upper(F.regexp_replace(F.col(identifier), "[^A-Za-z0-9]", ""))
    return df.select(people[0].alias("person"), compact.alias("identifier")).where("trim(person) <> '' and identifier <> ''").groupBy("person", "identifier").agg(F.count("*").alias("n"))


def aliases(names: DataFrame, name: str) -> DataFrame:
    """Other forms of names of two words, the given name first: (name, kind, alias)."""
    g, s = (F.regexp_extract(F.col(name), r"^(\S+)\s+(\S+)$", i) for i in (1, 2))
    forms = [("swapped", F.concat_ws(" ", s, g)), ("comma", F.concat(s, F.lit(", "), g)), ("initial", F.concat(F.substring(g, 1, 1), F.lit(". "), s)), ("surname_initial", F.concat(s, F.lit(" "), F.substring(g, 1, 1), F.lit("."))), ("capitals", F.concat_ws(" ", F.upper(s), g)), ("folded", fold(F.concat_ws(" ", g, s)))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("alias")) for k, f in forms]))
    return names.where((g != "") & (s != "")).select(F.col(name).alias("name"), each.alias("x")).select("name", "x.kind", "x.alias").where("alias <> name").distinct()


def filename_candidates(df: DataFrame, key: str, path: str, longest: int = 3) -> DataFrame:
    """Runs of up to longest words of file names without digits, that may be names: (key, run)."""
    stem = F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)
    found = runs(df.select(key, F.regexp_replace(stem, r"\d+", " ").alias("_stem")), key, "_stem", longest)
    return found.select(key, "run").distinct()


def name_order(c: Column) -> Column:
    """How a name of two parts is written: surname_initial (Roux S.), initial_surname (S. Roux), surname_first (ROUX
    Sabine or Roux, Sabine), given_first; null for what isn't two parts."""
    u, l = r"\p{Lu}", r"\p{L}"  # noqa: E741
    return (
        F.when(c.rlike(rf"^{u}[{l}'’-]+,?\s+(?:{u}\.[- ]?)+$"), "surname_initial")
        .when(c.rlike(rf"^(?:{u}\.[- ]?)+\s*{u}[{l}'’-]+$"), "initial_surname")
        .when(c.rlike(rf"^{u}[{l}'’-]+,\s*{u}[{l}'’-]+$") | (c.rlike(rf"^[{u}'’-]{{2,}}\s+{u}[{l}'’-]+$") & ~c.rlike(rf"^[{u}'’-]+\s+[{u}'’-]+$")), "surname_first")
        .when(c.rlike(rf"^{u}[{l}'’-]+\s+{u}[{l}'’-]+$"), "given_first")
    )


#: Sources of names in a text, the surest first, with what each is worth: identifiers, the dictionary, forms of address before
#: a name of two parts or one, kinds of organisations after or before a name, the file's name, and capitalised runs.
RANKED = {"identifier": 1.0, "gazetteer": 0.90, "title_full": 0.85, "org_prefix": 0.80, "org_suffix": 0.80, "title": 0.70, "file_name": 0.50, "run": 0.40}
# Forms of address, kinds of organisations before their name, and legal forms after it.
_ADDRESS = r"(?:M\.|Mr\.?|Mme|Mlle|Madame|Monsieur|Dr\.?|Dre|Docteur|Prof\.|Me|Frau|Herrn?|Mrs\.?|Ms\.?)"
_ORG = r"(?:Clinique|Cabinet|Laboratoire|Pharmacie|Fondation|Fiduciaire|Garage|Imprimerie|Institut|Centre|Caisse|Assurance|Banque|École|Hôpital)"
_LEGAL = r"(?:SA|Sàrl|SARL|SAS|AG|GmbH|SCM|SNC|Ltd)"
_NAME = r"[^\W\d_a-zà-öø-ÿ][\w’'-]*"
_RULES = [
    ("title_full", rf"\b{_ADDRESS}\s+({_NAME}\s+{_NAME})"),
    ("title", rf"\b{_ADDRESS}\s+({_NAME})"),
    ("org_prefix", rf"\b({_ORG}(?:\s+(?:de|du|des|la|le|d'|l'))*\s+{_NAME})"),
    ("org_suffix", rf"\b({_NAME}(?:\s+{_NAME})?\s+{_LEGAL})\b"),
    ("run", rf"(?<=[^\s.!?:]\s)({_NAME}\s+{_NAME})"),
]


def document_names(df: DataFrame, key: str, text: str, entries: DataFrame, schemes: dict[str, str], most: int = 500) -> DataFrame:
    """Names and identifiers in texts, with the source that tells them: (key, at, size, surface, source, confidence).

    at and size count words from 1. Where two overlap the surer source has it, then the longer, then the earlier one. A
    text keeps its most surest names. Null texts have none; key is unique.
    """
    rules = [(s, re.compile(p)) for s, p in _RULES] + [("identifier", re.compile(f"({p})")) for p in schemes.values()]
    kind = dict(df.dtypes)[key]
    word = re.compile(r"[^\W_]+")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in frame.itertuples(index=False, name=None):
                starts = [m.start() for m in word.finditer(t)]
                for source, pattern in rules:
                    for m in pattern.finditer(t):
                        a, b = m.span(1)
                        at = bisect.bisect_left(starts, a)
                        size = bisect.bisect_left(starts, b) - at
                        if size:
                            out.append((k, at + 1, size, m.group(1), source))
            yield pd.DataFrame(out, columns=[key, "at", "size", "surface", "source"])

    rows = df.where(F.col(text).isNotNull()).select(key, text)
    by_rule = spread(rows).mapInPandas(run, f"`{key}` {kind}, at int, size int, surface string, source string")
    by_dictionary = longest_matches(rows, key, text, entries).select(key, "at", "size", F.col("run").alias("surface"), F.lit("gazetteer").alias("source"))
    rank = F.array_position(F.array(*map(F.lit, RANKED)), F.col("source"))
    every = checkpointed(by_rule.unionByName(by_dictionary).withColumn("rank", rank.cast("int")).groupBy(key, "at", "size").agg(F.min_by(F.struct("surface", "source", "rank"), "rank").alias("x")).select(key, "at", "size", "x.*"))
    # only candidates that share a word meet
    words = every.select(key, "at", "size", "rank", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w"))
    other = words.select(key, "w", F.col("at").alias("o_at"), F.col("size").alias("o_size"), F.col("rank").alias("o_rank"))
    better = F.struct(F.col("o_rank"), -F.col("o_size"), F.col("o_at")) < F.struct(F.col("rank"), -F.col("size"), F.col("at"))
    beaten = words.join(other, [key, "w"]).where(better).select(key, "at", "size").distinct()
    kept = every.join(beaten, [key, "at", "size"], "left_anti").withColumn("confidence", F.element_at(F.array(*map(F.lit, RANKED.values())), F.col("rank")))
    return best_per(kept, [key], [F.desc("confidence"), F.asc("at")], most).select(key, "at", "size", "surface", "source", "confidence")

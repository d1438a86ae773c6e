"""The text pipeline: cleaning, structure, chunks, sections, cards, profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.numbers import dates_in_text

#: A document is long beyond so many code points; chunks aim at so many bytes (short) or code points (long).
LONG, SIZE, TAIL = 60_000, 1200, 200
#: A long chunk may end at a sentence beyond this share of its size; tables and lists stay whole up to twice it.
CUT_SHARE = 0.6


def is_long(df: DataFrame, document: str, text: str) -> DataFrame:
    """Documents (document) whose pages together are long."""
    return df.groupBy(document).agg(F.sum(F.length(text)).alias("n")).where(F.col("n") > LONG).select(document)


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text, by blank lines, else by lines; trimmed, none empty."""
    blocks = F.split(text, r"\n[ \t]*\n")
    parts = F.when(F.size(blocks) > 1, blocks).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def pack_short(text: str, size: int = SIZE, tail: int = TAIL) -> list[str]:
    """Paragraphs packed into chunks of at most size UTF-8 bytes; a paragraph beyond it is one chunk, and a short
    last chunk joins the one before."""
    blocks = [p for p in (b.strip() for b in re.split(r"\n[ \t]*\n", text)) if p]
    parts = blocks if len(blocks) > 1 else [p for p in (b.strip() for b in text.split("\n")) if p]
    out: list[str] = []
    used = 0
    for p in parts:
        n = len(p.encode())
        if out and used + n + 2 <= size:
            out[-1] += "\n\n" + p
            used += n + 2
        else:
            out.append(p)
            used = n
    if len(out) > 1 and len(out[-1].encode()) < tail:
        last = out.pop()
        out[-1] += "\n\n" + last
    return out


def pack_long(text: str, size: int = SIZE) -> list[str]:
    """Chunks of about size code points cut at sentence ends; a table or list keeps together up to twice the size."""
    out: list[str] = []
    held = ""
    for block in (b.strip() for b in re.split(r"\n[ \t]*\n", text)):
        if not block:
            continue
        lines = block.split("\n")
        atomic = len(lines) > 1 and sum(bool(re.match(r"\s*(?:[-*•|]|\d+[.)])", x)) for x in lines) * 2 > len(lines)
        limit = 2 * size if atomic else size
        if held and len(held) + len(block) + 2 > limit:
            out.append(held)
            held = ""
        held = f"{held}\n\n{block}" if held else block
        while len(held) > limit:
            ends = [m.end() for m in re.finditer(r"[.!?…]\s+|\n", held[:limit])]
            cut = next((e for e in reversed(ends) if e >= CUT_SHARE * size), 0) or (held.rfind(" ", 0, limit) + 1) or limit
            out.append(held[:cut].rstrip())
            held = held[cut:].lstrip()
    return [*out, held] if held else out


def chunks(df: DataFrame, document: str, page: str, text: str, long: DataFrame | None = None) -> DataFrame:
    """Passages of pages: chunk_id (document#pPage#sNumber), document, page, section, text. long: documents cut
    as long ones. A null text has none."""
    marked = df.withColumn("_long", F.lit(False)) if long is None else df.join(long.withColumn("_long", F.lit(True)), document, "left").na.fill(False, ["_long"])
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (d, p, i, c)
                for d, p, t, is_long_ in frame.itertuples(index=False, name=None)
                if isinstance(t, str)
                for i, c in enumerate(pack_long(t) if is_long_ else pack_short(t), 1)
            ]
            yield pd.DataFrame(rows, columns=["document", "page", "section", "text"])

    out = marked.select(document, page, text, "_long").mapInPandas(run, f"document {kinds[document]}, page {kinds[page]}, section int, text string")
    return out.select(F.format_string("%s#p%s#s%s", F.col("document").cast("string"), F.col("page").cast("string"), F.col("section").cast("string")).alias("chunk_id"), "document", "page", "section", "text")


def header_key(line: Column) -> Column:
    """What a repeated line has in common from page to page: numbers are one sign."""
    return F.trim(F.lower(F.regexp_replace(line, r"\d+", "#")))


def repeated_lines(df: DataFrame, document: str, page: str, text: str, edge: int = 2, most_chars: int = 100, most_numbers: int = 3, least_pages: int = 4) -> DataFrame:
    """Lines at page edges that at least half of a document's pages repeat: (document, key, pages)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ends = F.concat(F.slice(lines, 1, edge), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - edge + 1), edge))
    pages = df.where(F.length(F.trim(F.col(text))) > 0).groupBy(document).agg(F.countDistinct(page).alias("of"))
    keys = df.select(document, page, F.explode(ends).alias("line")).where((F.length("line") <= most_chars) & (F.regexp_count("line", F.lit(r"\d+")) <= most_numbers))
    counted = keys.groupBy(document, header_key(F.col("line")).alias("key")).agg(F.countDistinct(page).alias("pages"))
    return counted.join(pages, document).where((F.col("of") >= least_pages) & (F.col("pages") * 2 >= F.col("of"))).select(document, "key", "pages")


def cleaned(df: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Pages without lines of symbols alone and repeated edge lines, words joined over line ends."""
    keys = repeated_lines(df, document, page, text).groupBy(document).agg(F.collect_set("key").alias("_keys"))
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) == "") | x.rlike(r"[\p{L}\p{N}]"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_keys"), header_key(x)), F.lit(False)))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"(\p{L})[-¬­]\n(\p{Ll})", "$1$2")
    return df.join(keys, document, "left").withColumn(text, F.when(F.col(text).isNotNull(), joined)).drop("_keys")


def headings(df: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Section starts: Markdown headings, else short lines in capitals or numbered: (document, page, line, level, title)."""
    lines = df.select(document, page, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    marked = F.regexp_extract("t", r"^(#{1,6})\s+(.+?)\s*#*$", 1)
    numbered = F.regexp_extract("t", r"^((?:\d+\.)+\d*|\d+\.)\s+\p{Lu}.{2,80}$", 1)
    level = F.when(marked != "", F.length(marked)).when(numbered != "", F.size(F.filter(F.split(numbered, r"\."), lambda x: x != ""))).when(F.col("t").rlike(r"^[\p{Lu}][\p{Lu}\s\d'’/&—–-]{5,80}$"), 1)
    title = F.trim(F.regexp_replace("t", r"^#{1,6}\s+|\s*#+$", ""))
    return lines.where(level.isNotNull()).select(document, page, "line", level.cast("int").alias("level"), title.alias("title"))


def assign_sections(passages: DataFrame, sections: DataFrame, document: str, place: list[str]) -> DataFrame:
    """Each passage with the section in force where it starts: the last one that starts no later (an as-of join).
    Passages before the first section are left out. One union and one window, no join on a range."""
    from pyspark.sql import Window

    s = sections.select(document, *place, F.lit(0).alias("_kind"), F.struct(*sections.columns).alias("section"), F.lit(None).cast(passages.schema.simpleString()).alias("_row"))
    p = passages.select(document, *place, F.lit(1).alias("_kind"), F.lit(None).cast(s.schema["section"].dataType).alias("section"), F.struct(*passages.columns).alias("_row"))
    w = Window.partitionBy(document).orderBy(*place, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = s.unionByName(p).withColumn("section", F.last("section", ignorenulls=True).over(w))
    return both.where((F.col("_kind") == 1) & F.col("section").isNotNull()).select("_row.*", F.col("section.title").alias("section_title"))


def cards(df: DataFrame, document: str, page: str, text: str, most: int = 12_000) -> DataFrame:
    """One digest a document: the first sentence of every page in order, cut at most code points."""
    first = F.regexp_extract(text, r"(?s)^\s*(.+?[.!?…])(?:\s|$)", 1)
    digest = F.when(first != "", first).otherwise(F.substring(F.trim(F.col(text)), 1, 200))
    rows = df.where(F.length(F.trim(F.col(text))) > 0).groupBy(document).agg(F.array_sort(F.collect_list(F.struct(page, digest.alias("d")))).alias("x"))
    return rows.select(document, F.substring(F.concat_ws(" ", F.transform("x", lambda x: x["d"])), 1, most).alias("card"))


def document_date(text: Column) -> Column:
    """The date a text is from: one after a date label, else the only one in its first lines; several are none."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 12), "\n")
    labelled = dates_in_text(F.regexp_extract(head, r"(?im)^\s*(?:date|le|datum)\s*:?\s*(.+)$", 1))
    every = dates_in_text(head)
    return F.when(F.size(labelled) == 1, labelled[0]).when(F.size(every) == 1, every[0])

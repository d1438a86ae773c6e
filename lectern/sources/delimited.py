"""Delimited files: decoding, choosing the delimiter, records with their physical rows."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(content: bytes) -> str:
    """UTF-8, its mark dropped, else Windows-1252; bytes that has no character for are replaced."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def field_count(line: str, delimiter: str) -> int:
    """Fields of a line, delimiters within quotes not counted."""
    quoted, n = False, 1
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            n += 1
    return n


def consistency(lines: list[str], delimiter: str) -> tuple[int, int]:
    """How many lines share the commonest width of two or more, and that width."""
    widths = Counter(w for w in (field_count(x, delimiter) for x in lines if x.strip()) if w >= 2)
    return max(((n, w) for w, n in widths.items()), default=(0, 0))


def delimiter_of(text: str) -> str:
    """Comma or semicolon, by consistency; a tie goes to the semicolon if it cuts at all."""
    lines = text.splitlines()
    comma, semicolon = consistency(lines, ","), consistency(lines, ";")
    return ";" if semicolon >= comma and semicolon[1] > 1 else ","


def records(text: str) -> list[tuple[int, list[str | None]]]:
    """Records with the physical row each starts at (from 1, blank lines counted); blank cells are None, and
    records may be of any length."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text))
    out, row = [], 1
    for cells in reader:
        if any(c.strip() for c in cells):
            out.append((row, [c if c.strip() else None for c in cells]))
        row = reader.line_num + 1
    return out


def read_csv(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Every record of every file under path: file, sheet (the file's stem), source_row, row_index, cells."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in frame.itertuples(index=False, name=None):
                rows = records(decode(bytes(content)))
                yield pd.DataFrame({"file": name, "source_row": [r for r, _ in rows], "row_index": range(len(rows)), "cells": [c for _, c in rows]})

    out = files.mapInPandas(run, "file string, source_row int, row_index int, cells array<string>")
    return out.withColumn("sheet", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))


def wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """Ragged cells as columns; cells a record lacks are null."""
    return rows.select("file", "row_index", "source_row", *[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


#: A delimiter that isn't between quotes: an even number of quotes follows it.
_OUTSIDE = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every line of delimited UTF-8 files in splits, however large: file, start (of its split), delimiter, cells, broken.

    Each file's delimiter is the one that cuts most of its lines into equally many cells, two or more, a tie going to the
    semicolon. Quoted cells lose their quotes, blank ones are null. A record that goes over a line end leaves lines with an
    odd number of quotes: these are marked broken, without cells, for read_csv to read their files as a whole.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")).where("trim(line) <> ''")
    bare = F.regexp_replace("line", '"[^"]*"', "")
    widths = lines.select("file", F.explode(F.array(*[F.struct(F.lit(d).alias("delimiter"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1).alias("width")) for d in (",", ";")])).alias("x")).select("file", "x.*")
    modes = widths.where("width >= 2").groupBy("file", "delimiter", "width").agg(F.count("*").alias("n"))
    best = modes.groupBy("file").agg(F.max_by("delimiter", F.struct("n", "width", "delimiter")).alias("delimiter"))
    broken = F.regexp_count("line", F.lit('"')) % 2 == 1
    cut = F.when(F.col("delimiter") == ",", F.split("line", "," + _OUTSIDE)).otherwise(F.split("line", ";" + _OUTSIDE))
    unquoted = lambda c: F.when(c.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = F.transform(cut, lambda c: F.when(F.trim(unquoted(c)) != "", unquoted(c)))
    return lines.join(best, "file", "left").select("file", "start", "delimiter", F.when(~broken, cells).alias("cells"), broken.alias("broken"))

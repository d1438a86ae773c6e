"""Cutting long texts into pieces of bounded size by content-defined chunking.

A rolling hash over the last few code points marks landmarks, places that depend only on the text around them.
From the end of a piece the next cut is sought between a least and a greatest size: the first landmark there, or
where there is none the place of least hash, is snapped to the nearest natural boundary, a paragraph end before a line end
before a sentence end before a word end. Since landmarks and boundaries depend on nearby text alone, cuts fall back into step after an edit, and
only neighbouring pieces change. Each piece starts with the end of the one before (the overlap), from a word
start where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokenize import BASE

#: Greatest piece, greatest overlap, and least step from cut to cut, in code points.
MAX_SIZE, OVERLAP, LEAST = 1200, 120, 700
#: Code points a landmark's hash sees; one place in 2 ** RARITY is a landmark.
WINDOW, RARITY = 24, 6
_ENDS = {
    "paragraph": re.compile(r"\n[^\S\n]*\n\s*"),
    "line": re.compile(r"\n\s*"),
    "sentence": re.compile(r"[.!?…][»\"')\]]*\s+"),
    "word": re.compile(r"\s+"),
}


def rolled(text: str) -> np.ndarray:
    """Hashes of every WINDOW consecutive code points; the i-th is of those that end at place i + WINDOW."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.uint64)
    h = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(BASE) + codes[i : i + len(h)] + np.uint64(1)
    return h


def landmarks(h: np.ndarray) -> np.ndarray:
    """Places whose last WINDOW code points hash to a landmark."""
    return np.flatnonzero((h >> np.uint64(64 - RARITY)) == 0) + WINDOW


def cuts(text: str, max_size: int = MAX_SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, end, overlap, boundary): text[start:end] with its first overlap code points repeated;
    boundary says what ends it (paragraph, line, sentence, word, none, or end)."""
    if not 0 <= overlap < max_size or not 0 < least <= max_size - overlap:
        raise ValueError("sizes must satisfy 0 <= overlap < max_size and 0 < least <= max_size - overlap")
    n = len(text)
    if n <= max_size:
        return [(0, n, 0, "end")]
    h = rolled(text)
    marks = landmarks(h)
    ends = {kind: np.fromiter((m.end() for m in pattern.finditer(text)), np.int64) for kind, pattern in _ENDS.items()}
    out, start, done = [], 0, 0
    while n - start > max_size:
        lo, hi = done + least, start + max_size
        at = np.searchsorted(marks, lo)
        mark = int(marks[at]) if at < len(marks) and marks[at] <= hi else max(lo, WINDOW) + int(h[max(lo - WINDOW, 0) : hi - WINDOW + 1].argmin()) if hi >= WINDOW else hi
        cut, kind = hi, "none"
        for kind_, places in ends.items():
            near = places[np.searchsorted(places, lo) : np.searchsorted(places, hi, "right")]
            if len(near):
                cut, kind = int(near[np.abs(near - mark).argmin()]), kind_
                break
        again = cut
        if overlap:
            words = ends["word"]
            i = np.searchsorted(words, cut - overlap)
            again = int(words[i]) if i < len(words) and words[i] < cut else cut - overlap
        out.append((start, cut, done - start, kind))
        start, done = again, cut
    out.append((start, n, done - start, "end"))
    return out


def pieces(df: DataFrame, key: str = "row_id", text: str = "text", max_size: int = MAX_SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """One row a piece: key, piece (from 1), start (code points), n_chars, n_overlap, boundary, text.

    A null text has no piece; an empty one has one empty piece. Each piece without its first n_overlap code
    points, one after another, gives the text again. Rows with equal keys are cut each for itself; other
    columns are dropped, so names cannot clash. An empty table gives no rows.
    """
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (k, i, a, b - a, o, why, t[a:b])
                for k, t in frame.itertuples(index=False, name=None)
                if isinstance(t, str)
                for i, (a, b, o, why) in enumerate(cuts(t, max_size, overlap, least), 1)
            ]
            yield pd.DataFrame(rows, columns=[key, "piece", "start", "n_chars", "n_overlap", "boundary", "text"])

    schema = f"`{key}` {kind}, piece int, start int, n_chars int, n_overlap int, boundary string, text string"
    return df.select(F.col(key), F.col(text).alias("text")).mapInPandas(run, schema)


def oversized(df: DataFrame, key: str = "row_id", text: str = "text", max_size: int = MAX_SIZE) -> DataFrame:
    """Keys of the texts that had to be cut: those with a second piece."""
    return pieces(df, key, text, max_size).where("piece = 2").select(key)

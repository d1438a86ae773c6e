"""Ports to engines outside: recognition of page images, embeddings, speech. Each is a plain function that workers call in
batches; what it returns, and what it fails on, becomes rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import spread

#: Least confidence of a page's text; inputs and characters of one call for embeddings.
SURE, MOST_INPUTS, MOST_CHARS = 0.6, 16, 20_000


class OcrProvider(Protocol):
    """Text and confidence of a page image."""

    def __call__(self, image: bytes) -> tuple[str, float]: ...


class PageRasterizer(Protocol):
    """Images of a file's pages, in order."""

    def __call__(self, content: bytes) -> list[bytes]: ...


class Embedder(Protocol):
    """One vector a text."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class SpeechToText(Protocol):
    """The words of a recording, with the seconds each starts at."""

    def __call__(self, audio: bytes) -> list[tuple[float, str]]: ...


def rasterised(files: DataFrame, key: str, content: str, rasterizer: PageRasterizer) -> DataFrame:
    """Pages of files as images: (key, page from 1, image, error); a file that fails is one row with its error."""
    kind = dict(files.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, c in frame.itertuples(index=False, name=None):
                try:
                    rows.extend((k, i, image, None) for i, image in enumerate(rasterizer(bytes(c)), 1))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((k, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, "page", "image", "error"]).astype({"page": "Int32"})

    return spread(files.where(F.col(content).isNotNull()).select(key, content)).mapInPandas(run, f"`{key}` {kind}, page int, image binary, error string")


def recognised(pages: DataFrame, key: str, image: str, provider: OcrProvider, sure: float = SURE) -> DataFrame:
    """Pages read by a provider: (key, text, confidence, status); status is recognised, below_threshold, no_text or error.
    A failed page is tried once more alone, so one page's fault isn't its batch's."""
    kind = dict(pages.dtypes)[key]

    def read(content: bytes) -> tuple[str | None, float | None, str]:
        for _ in range(2):
            try:
                text, confidence = provider(content)
            except Exception:
                continue
            return text, confidence, "no_text" if not text.strip() else "recognised" if confidence >= sure else "below_threshold"
        return None, None, "error"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *read(bytes(c))) for k, c in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[key, "text", "confidence", "status"])

    return spread(pages.where(F.col(image).isNotNull()).select(key, image)).mapInPandas(run, f"`{key}` {kind}, text string, confidence double, status string")


def batches(lengths: list[int], most_inputs: int = MOST_INPUTS, most_chars: int = MOST_CHARS) -> list[int]:
    """Sizes of consecutive calls: each takes inputs while they are few and short enough, and at least one."""
    out, held, used = [], 0, 0
    for n in lengths:
        if held and (held == most_inputs or used + n > most_chars):
            out.append(held)
            held, used = 0, 0
        held, used = held + 1, used + n
    return [*out, held] if held else out


def embedded(passages: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """Passages with their vectors: (key, embedding, call), in calls of bounded size within each partition."""
    kind = dict(passages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, rows = 0, []
            for call, n in enumerate(batches([len(t) for t in frame[text]])):
                part = frame.iloc[at : at + n]
                rows.extend((k, v, call) for k, v in zip(part[key], embedder(part[text].tolist()), strict=True))
                at += n
            yield pd.DataFrame(rows, columns=[key, "embedding", "call"])

    return spread(passages.where(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, f"`{key}` {kind}, embedding array<double>, call int")


def transcribed(recordings: DataFrame, key: str, audio: str, engine: SpeechToText) -> DataFrame:
    """Words of recordings: (key, second, word)."""
    kind = dict(recordings.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, s, w) for k, c in frame.itertuples(index=False, name=None) for s, w in engine(bytes(c))]
            yield pd.DataFrame(rows, columns=[key, "second", "word"])

    return spread(recordings.where(F.col(audio).isNotNull()).select(key, audio)).mapInPandas(run, f"`{key}` {kind}, second double, word string")


def server_events(tokens: Iterator[str], answer: str) -> Iterator[str]:
    """Tokens of an answer as server-sent events, closed by a mark."""
    import json

    for t in tokens:
        yield f"data: {json.dumps({'id': answer, 'delta': t}, ensure_ascii=False)}\n\n"
    yield "data: [DONE]\n\n"

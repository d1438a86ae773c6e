"""Encoding a corpus by a byte-level BPE vocabulary.

Text is cut into pieces without a regular expression. Every code point is mapped to one of a few classes by
a lookup array; each class stands for a transition function of a small automaton over "what the piece before
me is". Functions compose associatively, so the states of a whole batch of texts come out of one scan:
positions whose function is constant on what can precede them are resolved at once, the others by composing
along ever longer strides (doubling). Piece starts follow from the states. The pieces are then merged by
their ranks; merged pieces are kept in a bounded cache, since the words of a corpus repeat.

The vocabulary is a rank file (one base64 token and its rank per line); its path is a parameter.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from sys import maxunicode

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pieces a worker keeps merged; when full the cache is emptied, which costs time but no result.
CACHE_PIECES = 400_000
#: Code points handled in one vectorised step.
STEP = 1 << 18
#: An odd base for hashes of pieces and its inverse modulo 2 ** 64.
BASE = 6364136223846793005
INVERSE = pow(BASE, -1, 1 << 64)

# Classes of code points. K1 and K2 are letters that can continue an apostrophe.
LETTER, NUMBER, SPACE, BLANK, OTHER, APOSTROPHE, K1, K2 = range(8)
# States: class of the running piece; A is an apostrophe that opens a piece, E1 waits for a second letter,
# END closes a contraction, BEGIN stands before a text.
S_L, S_N, S_S, S_W, S_O, S_A, S_E1, S_END, S_BEGIN = range(9)
STATES = 9
#: The class before the first code point of a text; the mark of a state that depends on the one before.
BEGINNING, OPEN = 8, 255


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories the vocabulary's published pattern names."""
    import regex

    table = np.full(maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, maxunicode + 1))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            run = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
            table[run] = kind
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    return table


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, bytes, bytes]:
    """Transition functions by class; by (class before, class) the state after, or OPEN where it depends on the
    state before; by (state before, class) whether a piece starts."""
    f = np.zeros((8, STATES), np.uint8)
    f[LETTER], f[NUMBER], f[SPACE], f[BLANK], f[OTHER] = S_L, S_N, S_S, S_W, S_O
    f[APOSTROPHE] = S_A
    f[APOSTROPHE, [S_S, S_O, S_A]] = S_O
    f[K1], f[K2] = S_L, S_L
    f[K1, S_A], f[K2, S_A] = S_END, S_E1
    f[[LETTER, K1, K2], S_E1] = S_END
    start = np.ones((32, 8), np.uint8)
    letters = [LETTER, K1, K2]
    start[np.ix_([S_L, S_S, S_E1], letters)] = 0
    start[S_A, [K1, K2]] = 0
    start[[S_N, S_S], NUMBER] = 0
    start[np.ix_([S_S, S_O, S_A], [OTHER, APOSTROPHE])] = 0
    start[np.ix_([S_S, S_W], [SPACE, BLANK])] = 0
    value = np.zeros((32, 8), np.uint8)
    for before in range(9):
        images = {S_BEGIN} if before == BEGINNING else set(f[before].tolist())
        for c in range(8):
            after = {int(f[c, s]) for s in images}
            value[before, c] = after.pop() if len(after) == 1 else OPEN
    return f, value.tobytes(), start.tobytes()


def piece_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For code points of texts laid end to end, whether each opens a piece. begins: where the texts open."""
    f, value, start = _automaton()
    n = len(codes)
    c = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    # contraction letters: s d m t alone; l v r only before l e e of the same text
    a = np.flatnonzero(c == APOSTROPHE) + 1
    a = a[~first[a]]
    one = codes[a]
    two = np.where(~first[a + 1], codes[np.minimum(a + 1, n - 1)], 0)
    c[a[(one == 115) | (one == 100) | (one == 109) | (one == 116)]] = K1
    c[a[((one == 108) & (two == 108)) | ((one == 118) & (two == 101)) | ((one == 114) & (two == 101))]] = K2
    pair = np.empty(n, np.uint8)
    pair[1:] = c[:-1] << 3
    pair[begins] = BEGINNING << 3
    pair |= c
    state = np.frombuffer(bytearray(pair.tobytes().translate(value)), np.uint8)
    todo = np.flatnonzero(state == OPEN)
    if len(todo):
        # compose the functions of the open positions with those before them until a resolved one is reached
        fn = f[c[todo]]
        at = todo - 1
        slots = np.full(n, -1, np.int64)
        slots[todo] = np.arange(len(todo))
        where, left = todo, np.arange(len(todo))
        while len(left):
            s = slots[at[left]]
            ready, rest = left[s < 0], left[s >= 0]
            state[where[ready]] = fn[ready, state[at[ready]]]
            s = s[s >= 0]
            composed, reach = np.take_along_axis(fn[rest], fn[s].astype(np.int64), 1), at[s]
            slots[where[ready]] = -1
            fn[rest], at[rest] = composed, reach
            left = rest
    pair[1:] = state[:-1] << 3
    pair[begins] = S_BEGIN << 3
    pair |= c
    out = np.frombuffer(bytearray(pair.tobytes().translate(start)), bool)
    # the last blank of a run opens a piece when something else follows in the same text; a plain space
    # then takes what follows with it, which the states already say
    if n > 1:
        blank = (c == SPACE) | (c == BLANK)
        out[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
    return out


class _Merged(dict):
    """Piece to (ids); computes what is missing by merging ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge(piece.encode("utf-8", "replace"), self.ranks))
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank, leftmost first, is joined until none has a rank.

    A heap of candidate pairs over a linked list keeps long pieces at n log n.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        if not alive[i] or end[i] >= n:
            continue
        j = end[i]
        if end[j] - i != size:
            continue
        end[i], alive[j] = end[j], False
        if end[i] < n:
            left[end[i]] = i
            r = ranks.get(piece[i : end[end[i]]])
            if r is not None:
                heappush(heap, (r, i, end[end[i]] - i))
        if left[i] >= 0:
            k = left[i]
            r = ranks.get(piece[k : end[i]])
            if r is not None:
                heappush(heap, (r, k, end[i] - k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    if not os.path.exists(path):  # a worker of a machine that lacks the file has what the driver sent
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _merged(path: str) -> _Merged:
    return _Merged(load_ranks(path))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    out = []
    for factor in (BASE, INVERSE):
        steps = np.full(n + 1, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


_POWERS = lru_cache(maxsize=2)(_powers)


def _distinct(codes: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces, one place of each distinct one, and for each piece the number of its distinct one.

    Pieces are compared by a rolling hash taken from prefix sums; equality with the place kept is then
    checked code point by code point, and where it fails pieces keep a number of their own.
    """
    n = len(codes)
    up, down = _POWERS(1 << max(1, n - 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7919)) * up[:n], out=sums[1:])
        key = (sums[ends] - sums[cuts]) * down[cuts]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    number = np.empty(len(cuts), np.int64)
    number[order] = np.cumsum(new) - 1
    kept = order[new]
    size = ends - cuts
    shift = (cuts[kept[number]] - cuts).repeat(size)
    same = codes[np.minimum(np.arange(int(cuts[0]), int(cuts[0]) + len(shift)) + shift, n - 1)] == codes[cuts[0] : cuts[0] + len(shift)]
    if not same.all() or (size[kept[number]] != size).any():
        wrong = np.flatnonzero(~np.logical_and.reduceat(same, cuts - cuts[0]) | (size[kept[number]] != size))
        number[wrong] = len(kept) + np.arange(len(wrong))
        kept = np.concatenate((kept, wrong))
    return kept, number


def encode_texts(texts: list[str], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, with, for each text, how many; and for each piece its first code point
    in its text and its number of ids."""
    merged = _merged(path)
    ids_out, counts_out, offsets_out, sizes_out = [], [], [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= STEP):
            size += len(texts[stop])
            stop += 1
        part = texts[at:stop]
        at = stop
        joined = "".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        if not joined:
            counts_out.append(np.zeros(len(part), np.int64))
            continue
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        opens = np.cumsum(lengths) - lengths
        cuts = np.flatnonzero(piece_starts(codes, opens[lengths > 0]))
        ends = np.append(cuts[1:], len(codes))
        kept, number = _distinct(codes, cuts, ends)
        got = [merged[joined[a:b]] for a, b in zip(cuts[kept].tolist(), ends[kept].tolist(), strict=True)]
        size_of = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(size_of.sum()))
        sizes = size_of[number]
        sums = np.concatenate(([0], np.cumsum(sizes)))
        shift = (np.cumsum(size_of) - size_of)[number] - sums[:-1]
        ids_out.append(flat[np.arange(int(sums[-1])) + shift.repeat(sizes)])
        edge = np.searchsorted(cuts, np.append(opens, len(codes)))
        counts_out.append(np.diff(sums[edge]))
        offsets_out.append(cuts - opens.repeat(np.diff(edge)))
        sizes_out.append(sizes)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return cat(ids_out, np.int32), cat(counts_out, np.int64), cat(offsets_out, np.int64), cat(sizes_out, np.int64)


def decode_ids(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids, for round trips."""
    names = {v: k for k, v in load_ranks(path).items()}
    return b"".join(names[i] for i in ids).decode("utf-8", "replace")


def send(df: DataFrame, path: str) -> None:
    """Sends the vocabulary to the workers of df's session, once."""
    context = df.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_lectern_sent", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY, with_offsets: bool = False) -> DataFrame:
    """One row per row of df: key, ids (array of int), and with_offsets the code point at which each id's piece opens.

    A null or empty text has an empty list. Repeated keys and rows stay repeated; other columns are dropped,
    so names cannot clash. Special token strings in a text are ordinary text. An empty table gives no rows.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    send(df, path)
    schema = f"`{key}` {dict(df.dtypes)[key]}, ids array<int>" + (", offsets array<int>" if with_offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts, opens, sizes = encode_texts(texts, path)
            edges = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))]
            if with_offsets:
                columns.append(pa.ListArray.from_arrays(edges, pa.array(np.repeat(opens, sizes), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "offsets"][: len(columns)])

    return df.select(key, text).mapInArrow(run, schema)


def token_counts(texts: pd.Series, path: str = VOCABULARY) -> pd.Series:
    """Number of ids of each text; a null counts as empty."""
    clean = [t if isinstance(t, str) else "" for t in texts]
    return pd.Series(encode_texts(clean, path)[1], index=texts.index)

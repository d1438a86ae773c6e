"""Repairing text recognised from scanned pages.

Four kinds of noise are found and undone: words hyphenated over a line end, misrecognised characters, running
headers and page numbers.

Pages are read once: their words with places, line ends, edge lines and counts go to a table in the shared folder, and all
else are joins of its columns.

Words are judged by a lexicon of the whole corpus, its words with their frequency, each occurrence weighing as much as
the reader's confidence in its page. A symmetric-delete index over the frequent words (each word under itself and under
itself less one letter; words beyond SEGMENTED under fifths of themselves, of which two edits leave one whole) generates
candidates for every other word; candidates are weighed by an edit distance in which pairs of glyphs that recognisers
confuse cost little and all else costs too much, and among those left the frequencies of the bigrams with the words on
either side choose. A word gives way only to one that is many times as frequent. Each word is judged once for each pair of
neighbours, not for each place.

Lines at the edges of a page that other pages of its file repeat, give or take confused glyphs, are running
headers; so are lines whose shape stands at page edges all over the corpus and hardly elsewhere. The two outermost lines
of an edge are looked at, and each further one where all lines outside it are headers or page numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed, spread, written

# Glyphs as printed and what recognisers make of them.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("n", "ri"), ("i", "1"), ("l", "1"), ("t", "f"), ("f", "t"), ("a", "o"), ("o", "a"), ("s", "5"), ("m", "rn"), ("rn", "m"), ("b", "6"), ("é", "6"),
    ("é", "e'"), ("è", "e'"), ("h", "b"), ("b", "h"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("ii", "u"), ("v", "y"), ("y", "v"), ("i", "l"), ("l", "i"), ("w", "vv"), ("g", "9"), ("g", "q"), ("q", "g"), ("z", "2"), ("b", "8"), ("n", "u"), ("u", "n"),
    ("in", "m"), ("m", "in"), ("ni", "m"), ("m", "ni"), ("nn", "rm"), ("li", "h"), ("h", "li"), ("d", "ci"), ("a", "ci"), ("s", "8"), ("u", "li"), ("é", "ó"), ("ê", "é"), ("ü", "ii"), ("ä", "a'"), ("s", "$"), ("t", "l"), ("r", "i"), ("k", "lc"), ("n", "11"),
]
#: How many times as frequent the printed word must be, and how often it must occur, in hundredths of a sure occurrence.
TIMES, LEAST = 12, 600
#: What an occurrence on a page of unknown confidence weighs, in hundredths.
UNKNOWN = 90
#: Halves of a compound of which neither form is known that are this common make it one.
COMMON = 5000
#: Words longer than this are indexed by fifths instead of deletions.
SEGMENTED = 64
#: Words that are left out before any shuffle: the most frequent that need no repair. A bound, not a limit on the corpus.
SKIP = 5000
#: Pages whose parts a worker holds at once.
HELD = 500
#: Outermost lines of an edge that are looked at in any case.
EDGE = 2

_TOKEN = re.compile(r"[^\W_]+(?:['’´`][^\W\d_]+)*(?:(?<=e)['´`](?![\w]))?")
_ELISION = re.compile(r"(?:[ldnscjmt]|qu|jusqu|lorsqu|puisqu|quoiqu)['’]", re.IGNORECASE)
_COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:-[^\W\d_]++)+")
_LINE_END = re.compile(r"([-‐‑¬­])[^\S\n]*\n[^\S\n]*([^\W\d_]+)")
_LAST_WORD = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*)[^\S\n]?\Z")
_NUMBER = re.compile(r"(?=\S*\d)(?=\S*[OolIS])[\dOolIS]{2,}\Z")
_MIXED = re.compile(r"(?<![^\W_])[\dOolIS]*(?:\d[OolIS]|[OolIS]\d)[\dOolIS]*(?![^\W_])")
_CODE = re.compile(r"[A-Z]\d{6,}\Z")
_AT = re.compile(r"@|\(at\)|\[at\]|://|\.example", re.IGNORECASE)
_BLANK = re.compile(r"\s")


def _mails(text: str) -> list[tuple[int, int]]:
    """Where mail and web addresses stand: from each sign of one outwards to blanks, one blank after it passed."""
    out: list[tuple[int, int]] = []
    before, opened, asked, end = -1, 0, -1, -1
    for m in _AT.finditer(text):
        a = m.start()
        while a > max(before, 0) and not text[a - 1].isspace():
            a -= 1
        if a == before:  # no blank since the sign before, so the run began where that one's did
            a = opened
        if not asked <= m.end() + 1 <= end:
            found = _BLANK.search(text, m.end() + 1)
            asked, end = m.end() + 1, found.start() if found else len(text)
        out.append((a, end))
        before, opened = m.start(), a
    return out


_QUOTES = frozenset("'’´`")


@lru_cache(maxsize=200_000)
def _read_word(w: str) -> tuple[str, int]:
    """A token as a word, and how many signs of an elision before it are cut off."""
    cut = 0
    if not _QUOTES.isdisjoint(w):
        e = _ELISION.match(w)
        if e and len(w) > e.end():
            cut, w = e.end(), w[e.end() :]
    # numbers, also with letters for digits, and codes of capitals are no words
    code = w.isdigit() or (len(w) <= 3 and (_NUMBER.match(w) is not None or (w.isupper() and w.isalpha())))
    return ("#" if code else w.lower()), cut


def words(text: str) -> list[tuple[str, int, int]]:
    """Words of a text with their places, elisions cut off, in lower case; numbers and short words in capitals as #;
    mail addresses left out. Short words that mix letters and digits are words (see beside)."""
    out = []
    skip = _mails(text)
    at, stop = 0, len(skip)
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if at < stop:
            while at < stop and skip[at][1] <= a:
                at += 1
            if at < stop and skip[at][0] < b and a < skip[at][1]:
                continue
        w, cut = _read_word(m.group())
        out.append((w, a + cut, b))
    return out


def beside(word: str) -> str:
    """A word as its neighbours' context has it: short ones with digits are mostly codes and house numbers, so #."""
    return "#" if len(word) <= 3 and any(c.isdigit() for c in word) else word


_AS_DIGITS = str.maketrans("OolIS", "00115")


def odd_numbers(text: str) -> list[tuple[int, int, str]]:
    """Where letters stand for digits within a number, and the number meant: (a, b, digits)."""
    out = []
    skip = None
    for m in _MIXED.finditer(text):
        w = m.group()
        if _NUMBER.match(w) and not _CODE.match(w) and not re.fullmatch(r"\d+S", w):
            skip = _mails(text) if skip is None else skip
            if not any(a < m.end() and m.start() < b for a, b in skip):
                out.append((m.start(), m.end(), w.translate(_AS_DIGITS)))
    return out


def last_word(text: str, end: int) -> str:
    """The word, with its hyphens, that ends at a place or one blank before it; empty where none does."""
    if end and text[end - 1].isspace() and text[end - 1] != "\n":
        end -= 1
    a = end
    while a and (text[a - 1].isalpha() or text[a - 1] == "-"):
        a -= 1
    found = _LAST_WORD.search(text, a, end)
    return found.group(1) if found else ""


def line_ends(text: str) -> list[dict]:
    """Marks at line ends within words: a, b (of the mark and the line end) and the forms the word may have."""
    out = []
    mails = None
    for m in _LINE_END.finditer(text):
        left = last_word(text, m.start())
        if not left:
            continue
        mails = [(a, b + 1) for a, b in _mails(text)] if mails is None else mails
        if any(a < m.end() and m.start() < b for a, b in mails):
            continue
        mark, right = m.groups()
        last = left.rpartition("-")[2]
        runs_on = right[:1].islower() or (last.isupper() and right.isupper() and len(last) > 1)
        out.append({"a": m.start(), "b": m.start(2), "joined": (last + right).lower(), "compound": f"{last}-{right}".lower(), "whole": f"{left}-{right}".lower(), "hyphen": mark == "-", "head": last.lower(), "tail": right.lower(), "runs_on": runs_on})
    return out


_ENDS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("joined", pa.string()), ("compound", pa.string()), ("whole", pa.string()), ("hyphen", pa.bool_()), ("head", pa.string()), ("tail", pa.string()), ("runs_on", pa.bool_())]))
_EDGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("at", pa.int32()), ("depth", pa.int32()), ("is_page", pa.bool_()), ("tail", pa.int32()), ("bare", pa.string()), ("shape", pa.string()), ("explicit", pa.bool_())]))
_ODD = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("v", pa.string())]))
#: What reading a batch of pages gives: of every page its parts (tag page), and of the batch counts of words (tag word: x, n),
#: of neighbours, either one also as the other's context has it (tag pair: x, y, n), and of the shapes of inner lines (tag inner: x, n).
_PARTS = pa.schema([("tag", pa.string()), ("row_id", pa.int64()), ("page", pa.int64()), ("path", pa.string()), ("w", pa.list_(pa.string())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("odd", _ODD), ("ends", _ENDS), ("edges", _EDGES), ("x", pa.string()), ("y", pa.string()), ("n", pa.int64())])
_EDGE_DDL = "array<struct<a int, b int, at int, depth int, is_page boolean, tail int, bare string, shape string, explicit boolean>>"
_PARTS_DDL = (
    "tag string, row_id bigint, page bigint, path string, w array<string>, a array<int>, b array<int>, odd array<struct<a int, b int, v string>>, "
    "ends array<struct<a int, b int, joined string, compound string, whole string, hyphen boolean, head string, tail string, runs_on boolean>>, "
    f"edges {_EDGE_DDL}, x string, y string, n bigint"
)


def _counts(one: Counter[str], two: Counter[tuple[str, str]], inner: Counter[str]) -> Iterator[dict]:
    """Counts of a batch as rows; of neighbours either one also as the other's context has it."""
    yield from ({"tag": "word", "x": w, "n": n} for w, n in one.items())
    forms: Counter[tuple[str, str]] = Counter()
    for (p, w), n in two.items():
        for pair in {(beside(p), w), (p, beside(w))}:
            forms[pair] += n
    yield from ({"tag": "pair", "x": p, "y": w, "n": n} for (p, w), n in forms.items())
    yield from ({"tag": "inner", "x": s, "n": n} for s, n in inner.items())


def pages(df: DataFrame, key: str, text: str, path: str, page: str, confidence: str | None) -> DataFrame:
    """The parts of all pages and the counts of the corpus, as rows of _PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one: Counter[str] = Counter()
            two: Counter[tuple[str, str]] = Counter()
            inner: Counter[str] = Counter()
            rows = []
            for k, t, where, number, sure in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if t is None:
                    continue
                weight = UNKNOWN if sure is None or sure != sure else max(1, round(100 * min(max(sure, 0.0), 1.0)))
                number = None if number is None or number != number else int(number)
                found = words(t)
                ws = [w for w, _, _ in found]
                for w in ws:
                    one[w] += weight
                for w in _COMPOUND.findall(t):
                    one[w.lower()] += weight
                two.update(zip(ws, ws[1:], strict=False))
                inner.update(shapes(t)[EDGE:-EDGE])
                rows.append({"tag": "page", "row_id": k, "page": -k if number is None else number, "path": where, "w": ws, "a": [a for _, a, _ in found], "b": [b for _, _, b in found], "odd": [{"a": a, "b": b, "v": v} for a, b, v in odd_numbers(t)], "ends": line_ends(t), "edges": edge_lines(t, number, 0, EDGE + 1)})
                if len(rows) == HELD:
                    yield pa.RecordBatch.from_pylist(rows, _PARTS)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _PARTS)
            counts = _counts(one, two, inner)
            while some := list(islice(counts, 50_000)):
                yield pa.RecordBatch.from_pylist(some, _PARTS)

    sure = F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")
    rows = spread(df.select(F.col(key).cast("bigint"), F.col(text), F.col(path).cast("string"), F.col(page).cast("double"), sure))
    return written(rows.toDF("row_id", "text", "path", "page", "confidence").mapInArrow(run, _PARTS_DDL), "pages")


def _beside(word: Column) -> Column:
    return F.when((F.length(word) <= 3) & word.rlike(r"\d"), "#").otherwise(word)


def lexicon(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights (w, n) of words and hyphenated compounds, and frequencies (p, w, n) of neighbouring words, either one also
    as its neighbour's context has it (see beside)."""
    one = parts.where("tag = 'word'").groupBy(F.col("x").alias("w")).agg(F.sum("n").alias("n"))
    two = parts.where("tag = 'pair'").groupBy(F.col("x").alias("p"), F.col("y").alias("w")).agg(F.sum("n").alias("n"))
    return one, two


_BY_SEEN: dict[str, list[str]] = {}
for _printed, _seen in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_printed)


def unconfused(word: str) -> set[str]:
    """The word with each confused pair of glyphs longer than one on either side undone, in one place."""
    out = set()
    for seen, printed in _BY_SEEN.items():
        at = word.find(seen)
        while at >= 0:
            out |= {word[:at] + p + word[at + len(seen) :] for p in printed if len(seen) > 1 or len(p) > 1}
            at = word.find(seen, at + 1)
    return out


_BY_PRINTED: dict[str, list[tuple[str, str]]] = {}
for _printed, _seen in CONFUSIONS:
    _BY_PRINTED.setdefault(_printed[0], []).append((_printed, _seen))


def cost(printed: str, seen: str) -> float:
    """Weighted edit distance: 1 for a confused pair of glyphs; any other edit is too dear, as 99."""
    if abs(len(printed) - len(seen)) > 2:
        return 99.0
    # what both begin and end with costs nothing
    a, most = 0, min(len(printed), len(seen))
    while a < most and printed[a] == seen[a]:
        a += 1
    z = 0
    while z < most - a and printed[-1 - z] == seen[-1 - z]:
        z += 1
    printed, seen = printed[a : len(printed) - z], seen[a : len(seen) - z]
    n, m = len(printed), len(seen)
    if not n and not m:
        return 0.0
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            here = best.get((i, j), 99.0)
            if here > 2:
                continue
            if i < n and j < m and printed[i] == seen[j] and here < best.get((i + 1, j + 1), 99.0):
                best[i + 1, j + 1] = here
            if i < n:
                for p, q in _BY_PRINTED.get(printed[i], ()):
                    if seen.startswith(q, j) and printed.startswith(p, i):
                        at = (i + len(p), j + len(q))
                        if here + 1 < best.get(at, 99.0):
                            best[at] = here + 1.0
    return best.get((n, m), 99.0)


def segments(word: str, slack: int) -> list[str]:
    """Keys of the fifths of a long word; with slack, of all words of lengths and at places up to so many signs away.
    Two edits, each over a border of fifths at worst, leave one fifth whole."""
    out = []
    for length in range(len(word) - slack, len(word) + slack + 1):
        cuts = [length * i // 5 for i in range(6)]
        for i in range(5):
            for shift in range(-slack, slack + 1):
                a, b = cuts[i] + shift, cuts[i + 1] + shift
                if 0 <= a < b <= len(word):
                    out.append(f"{length}/{i}/{xxhash.xxh3_64_hexdigest(word[a:b].encode('utf-8', 'surrogatepass'))}")
    return sorted(set(out))


def repairs(counts: DataFrame) -> DataFrame:
    """Candidates (w, v, cost, n_w, n_v): words w that a more frequent word v may have been."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for w, n in frame.itertuples(index=False, name=None):
                if w == "#":
                    continue
                known = n >= LEAST
                if len(w) > SEGMENTED - 2:
                    if known:
                        out.extend((k, w, n, True) for k in segments(w, 0))
                    out.extend((k, w, n, False) for k in segments(w, 2))
                if len(w) > SEGMENTED:
                    continue
                own = {w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 2 else set())
                if len(w) == 2:
                    own |= {"?" + w[1], w[0] + "?"}
                if len(w) == 1:
                    own.add("?")
                if known:
                    out.extend((k, w, n, True) for k in own)
                asked = set(own) | unconfused(w)
                plain = w.translate(str.maketrans("0156", "olsb"))
                if plain != w:
                    asked.add(plain)
                    asked |= {plain[:i] + plain[i + 1 :] for i in range(len(plain))}
                out.extend((k, w, n, False) for k in asked)
            yield pd.DataFrame(out, columns=["k", "w", "n", "known"])

    every = counts.mapInPandas(keys, "k string, w string, n bigint, known boolean")
    index = every.where("known").select("k", F.col("w").alias("v"), F.col("n").alias("n_v"))
    asked = every.where("not known").select("k", "w", F.col("n").alias("n_w"))
    met = asked.join(index, "k").where((F.col("w") != F.col("v")) & (F.col("n_v") >= TIMES * F.col("n_w"))).dropDuplicates(["w", "v"])

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(w, v, cost(v, w), n_w, n_v) for w, v, n_w, n_v in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame([r for r in rows if r[2] <= (2 if len(r[0]) >= 6 else 1)], columns=["w", "v", "cost", "n_w", "n_v"])

    return met.select("w", "v", "n_w", "n_v").mapInPandas(weigh, "w string, v string, cost double, n_w bigint, n_v bigint")


def misread_words(parts: DataFrame, counts: DataFrame, bigrams: DataFrame, fixes: DataFrame) -> DataFrame:
    """Words to be repaired, of those that have fixes: row_id, a, b, w, v."""
    clean = counts.join(fixes.select("w").distinct(), "w", "left_anti").orderBy(F.desc("n"), "w").limit(SKIP).select(F.col("w").alias("t"))
    tokens = parts.where("tag = 'page'").select("row_id", "w", "a", "b", F.posexplode("w").alias("i", "t"))
    tokens = tokens.where("t <> '#'").join(F.broadcast(clean), "t", "left_anti")  # at most SKIP words
    neighbour = lambda i: F.coalesce(F.try_element_at("w", i), F.lit(""))
    places = tokens.select(
        "row_id", F.element_at("a", F.col("i") + 1).alias("a"), F.element_at("b", F.col("i") + 1).alias("b"), F.when(F.col("i") > 0, _beside(neighbour(F.greatest("i", F.lit(1))))).otherwise("").alias("p"), F.col("t").alias("w"), _beside(neighbour(F.col("i") + 2)).alias("q")
    )
    places = written(places.join(fixes.select("w").distinct(), "w", "left_semi").select("row_id", "a", "b", "p", "w", "q"), "places")
    # a word is judged once for each pair of neighbours
    near = places.select("p", "w", "q").distinct().join(fixes, "w")
    # context: how often the candidate, and the word as it stands, follow and precede the neighbours
    bi = lambda p, w, n: bigrams.select(F.col("p").alias(p), F.col("w").alias(w), F.col("n").alias(n))
    judged = (
        near.join(bi("p", "v", "pv"), ["p", "v"], "left")
        .join(bi("v", "q", "vq"), ["v", "q"], "left")
        .join(bi("p", "w", "pw"), ["p", "w"], "left")
        .join(bi("w", "q", "wq"), ["w", "q"], "left")
        .na.fill(0, ["pv", "vq", "pw", "wq"])
    )
    support = F.log1p(F.col("pv").cast("double")) + F.log1p(F.col("vq").cast("double"))
    score = support + F.log(F.col("n_v").cast("double")) / 2 - 2 * F.col("cost")
    # a word seen once beside its neighbour is this very one, which speaks for nothing
    again = lambda c: F.log1p(F.when(F.col(c) > 1, F.col(c)).otherwise(0).cast("double"))
    against = again("pw") + again("wq")
    # short words, and words that are themselves common, need a neighbour that speaks for the candidate
    fits = F.when((F.length("w") <= 3) | (F.col("n_w") >= LEAST), support > against + 1).otherwise(F.lit(True))
    chosen = judged.where(fits).groupBy("p", "w", "q").agg(F.max_by("v", F.struct(score, F.col("v"))).alias("v"))
    return places.join(chosen, ["p", "w", "q"]).select("row_id", "a", "b", "w", "v")


def split_words(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Words hyphenated over a line end: row_id, a, b (of the mark and the line end), the joined word, and whether it is a
    frequent one."""
    ends = parts.where("tag = 'page'").select("row_id", F.inline("ends"))
    # forms are judged once, however often they are met
    forms = ends.select("joined", "compound", "whole", "head", "tail", "hyphen", "runs_on").distinct()  # head and tail follow from whole and joined
    known = lambda c, n: counts.select(F.col("w").alias(c), F.col("n").alias(n))
    judged = forms.join(known("joined", "n_j"), "joined", "left").join(known("compound", "n_c"), "compound", "left").join(known("whole", "n_o"), "whole", "left").join(known("head", "n_h"), "head", "left").join(known("tail", "n_t"), "tail", "left").na.fill(0, ["n_j", "n_c", "n_o", "n_h", "n_t"])
    compound = F.greatest("n_c", "n_o")
    # where neither form is known, two halves that are common words are taken for a compound
    split = judged.where(
        F.when(F.col("n_j") > compound, True)
        .when(compound > F.col("n_j"), F.lit(False))
        .otherwise(F.col("runs_on") & (~F.col("hyphen") | (F.least("n_h", "n_t") < COMMON)))
    ).select("joined", "compound", "whole", "hyphen", "runs_on", (F.col("n_j") >= LEAST).alias("known")).distinct()
    return ends.join(split, ["joined", "compound", "whole", "hyphen", "runs_on"]).select("row_id", "a", "b", "joined", "known")


_EXPLICIT = re.compile(r"[A-Za-z\[\]–—-]")
_PN = r"[\dOolISB]{1,4}"
PAGE = re.compile(rf"(?:[PpF][aoe]g[ec]|[S5][ec][il1]t[ec]|[Pp]\.|[S5]\.)?\s*[-–—\[(]?\s*({_PN})\s*(?:(?:/|sur|von|of|de|sui|5ur|v0n|vou)\s*{_PN})?\s*[-–—\])]?\s*\Z")
_APART = re.compile(r"\s[\s|]|\t")  # what must stand before a number at a line's end
_TAIL = re.compile(rf"(?:\s{{2,}}|\t|\s\|\s)((?:[PpF][aoe]g[ec]|[S5][ec][il1]t[ec]|[Pp]\.|[S5]\.)?\s*[-–—\[(]?\s*{_PN}\s*(?:(?:/|sur|von|of|de|sui|5ur|v0n|vou)\s*{_PN})?\s*[-–—\])]?)\s*\Z")


def _value(digits: str) -> int:
    return int(digits.translate(str.maketrans("OoSBlI", "005811")))


def _is_page(part: str, page: int | None) -> bool:
    m = PAGE.match(part.strip())
    if not m:
        return False
    bare = re.fullmatch(rf"{_PN}", part.strip()) is not None
    confused = any(c in "OolISB" for c in m.group(1))
    if page is None:
        return True
    return _value(m.group(1)) == page or (not bare and confused) or (not bare and len(m.group(1)) == len(str(page)) and confused)


_ALIKE = {"0": "o", "a": "o", "à": "o", "1": "l", "i": "l", "5": "s", "6": "b", "h": "b", "8": "b", "c": "e", "é": "e", "è": "e", "ê": "e", "f": "t", "y": "v", "u": "n", "q": "g", "9": "g"}


_SAME = str.maketrans(_ALIKE | {c: "" for c in " \t\r\n\xa0\u202f'’´`.|_"})


_SAME_LINES = {c: x for c, x in _SAME.items() if c != ord("\n")}


def skeleton(line: str, same: dict[int, str] = _SAME) -> str:
    """A line with confused glyphs alike, without spaces and marks."""
    s = line.lower()
    for seen, printed in (("ri", "n"), ("cl", "d"), ("ii", "u"), ("e'", "e"), ("rn", "m"), ("in", "m"), ("ni", "m")):
        s = s.replace(seen, printed)
    return s.translate(same)


_DIGITS = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


def shape(line: str) -> str:
    """The skeleton of a line whatever its numbers; digits within words are glyphs."""
    return skeleton(_DIGITS.sub("#", line) if any(c.isdigit() for c in line) else line)


def shapes(text: str) -> list[str]:
    """The shapes of all lines of a text that aren't blank, read at once, as no glyph goes over a line end."""
    return [x for line, x in zip(text.split("\n"), skeleton(_DIGITS.sub("#", text), _SAME_LINES).split("\n"), strict=True) if line and not line.isspace()]


def edge_lines(text: str, page: int | None, first: int, last: int) -> list[dict]:
    """Lines at the edges of a page, from depth first to before last: a, b, at (0 top, 1 bottom), depth, is_page (the page's
    number alone), tail (where a number ends the line, its start, else b), bare (skeleton), shape (digits as #), explicit
    (the number is marked as one)."""
    spans, at, out = [], 0, []
    for line in text.split("\n"):
        if line.strip():
            spans.append((at, at + len(line)))
        at += len(line) + 1
    for end, own in ((0, spans[first:last]), (1, spans[::-1][first:last])):
        for depth, (a, b) in enumerate(own, first):
            line = text[a:b]
            alone = _is_page(line, page)
            m = None if alone or not _APART.search(line) else _TAIL.search(line)
            tail = a + m.start() if m and _is_page(m.group(1), page) else b
            bare = text[a:tail].strip()
            out.append({"a": a, "b": b, "at": end, "depth": depth, "is_page": alone, "tail": tail, "bare": skeleton(bare), "shape": shape(bare), "explicit": bool(m) and _EXPLICIT.search(m.group(1)) is not None})
    return out


def deeper(df: DataFrame, edges: DataFrame, key: str, text: str, page: str, first: int) -> DataFrame:
    """Lines at depth first of the edges (row_id, at) given: rows as of edge_lines with row_id, page and path left out."""

    @F.arrow_udf(_EDGE_DDL)
    def read(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        return pa.array([edge_lines(t or "", None if n is None or n != n else int(n), first, first + 1) for t, n in zip(texts.to_pylist(), numbers.to_pylist(), strict=True)], _EDGES)

    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"), F.col(page).cast("double").alias("n")).join(edges.select("row_id").distinct(), "row_id")
    return rows.select("row_id", F.inline(read("text", "n"))).join(edges.select("row_id", "at"), ["row_id", "at"], "left_semi")


def furniture(df: DataFrame, parts: DataFrame, key: str, text: str, page: str) -> DataFrame:
    """Running headers and page numbers: row_id, a, b, defect."""
    where = parts.where("tag = 'page'").select("row_id", "page", "path")

    def keyed(lines: DataFrame) -> DataFrame:
        """Lines with what they are compared by as numbers: file, own (file and skeleton, by two hashes), s (shape)."""
        return lines.select(
            "row_id", "page", "a", "b", "at", "depth", "is_page", "tail", "explicit", (F.length("bare") >= 8).alias("long"), F.xxhash64("path").alias("file"), F.struct(F.xxhash64("path", "bare").alias("x"), F.hash("bare").alias("y")).alias("own"), F.xxhash64("shape").alias("s")
        )

    every = written(keyed(parts.where("tag = 'page'").select("row_id", "page", "path", F.inline("edges"))), "edges")
    inner = parts.where("tag = 'inner'").groupBy(F.xxhash64("x").alias("s")).agg(F.sum("n").alias("inner"))
    lines, depth = every.where(F.col("depth") < EDGE), EDGE

    def flagged(some: DataFrame) -> DataFrame:
        """Running headers among lines: row_id, a, b, tail, at, depth."""
        body = some.where("not is_page and long")
        # a line repeated by different pages of its file; a page read twice doesn't count
        again = body.groupBy("own").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo < hi").select("own")
        repeated = body.join(again, "own", "left_semi").select("row_id", "a", "b", "tail", "at", "depth", "file", "s")
        # shapes of such lines; a running header's stands at edges and hardly anywhere else
        at_edge = body.groupBy("s").agg(F.count("*").alias("outer"), F.count_if(F.col("depth") >= EDGE).alias("deep"))
        kinds = (
            repeated.groupBy("s")
            .agg(F.countDistinct("file").alias("files"))
            .join(at_edge, "s")
            .join(inner, "s", "left")
            .where((F.coalesce("inner", F.lit(0)) - F.col("deep")) * 9 <= F.col("outer"))  # lines deeper than EDGE were counted as inner ones
            .select("s", "files")
        )
        kinds = checkpointed(kinds)
        found = ["row_id", "a", "b", "tail", "at", "depth"]
        both = repeated.join(kinds.select("s"), "s", "left_semi").select(found).unionByName(body.join(kinds.where("files >= 3").select("s"), "s", "left_semi").select(found))
        return checkpointed(both.distinct())

    headers = flagged(lines)
    while True:
        # edges all of whose lines so far are headers or numbers may hold more of them; the next line of each was read with
        # the outer ones, those beyond are read from the few pages that may have such headers
        gone = headers.select("row_id", "at", "depth").unionAll(lines.where("is_page").select("row_id", "at", "depth")).distinct()
        open_ = gone.groupBy("row_id", "at").agg(F.count("*").alias("k")).where(F.col("k") == depth).select("row_id", "at")
        if depth > EDGE:
            open_ = checkpointed(open_)
            if open_.isEmpty():
                break
        next_ = every.where(F.col("depth") == depth).join(open_, ["row_id", "at"], "left_semi") if depth == EDGE else keyed(deeper(df, open_, key, text, page, depth).join(where, "row_id"))
        more = checkpointed(next_.select(lines.columns))
        if more.isEmpty():
            break
        lines = lines.unionByName(more)
        # only lines like the new ones bear on them
        alike = lines.join(more.select("s").distinct(), "s", "left_semi").select(lines.columns)
        same = lines.join(more.select("own").distinct(), "own", "left_semi").join(more.select("s").distinct(), "s", "left_anti").select(lines.columns)
        new = flagged(checkpointed(alike.unionByName(same))).where(F.col("depth") == depth)
        headers, depth = headers.unionByName(new), depth + 1
        if new.isEmpty() and more.where("is_page").isEmpty():
            break
    numbers = lines.where("is_page").select("row_id", "a", "b", F.lit("page_number").alias("defect"))
    tails = headers.where("tail < b").select("row_id", "a", "b").unionAll(lines.where("not is_page and long and tail < b and explicit").select("row_id", "a", "b")).withColumn("defect", F.lit("page_number"))
    return numbers.unionAll(headers.select("row_id", "a", "b", F.lit("running_header").alias("defect"))).unionAll(tails).distinct()


def defects(df: DataFrame, key: str = "row_id", text: str = "text", path: str = "relative_path", page: str = "page_number", confidence: str | None = "confidence") -> DataFrame:
    """Noise on pages: row_id, a, b (code points), defect, repair. defect is hyphenation, misread,
    running_header or page_number; repair is what stands instead (null for headers and numbers, which go).

    Null and empty texts have none; a null path or page number only leaves out what it would have told, and a page of
    unknown confidence, or a table without that column, weighs like a good page. Keys are unique. Other columns are
    dropped, so names cannot clash. An empty table gives no rows.
    """
    parts = pages(df, key, text, path, page, confidence if confidence in df.columns else None)
    one, two = lexicon(parts)
    counts, bigrams = written(one, "words"), written(two, "neighbours")
    fixes = checkpointed(repairs(counts))
    wrong = misread_words(parts, counts, bigrams, fixes).select("row_id", "a", "b", F.lit("misread").alias("defect"), F.col("v").alias("repair"))
    halves = checkpointed(split_words(parts, counts))
    # neither half of a frequent word, one that is no misreading itself, is a misread one
    sure = halves.where("known").join(fixes.select(F.col("w").alias("joined")), "joined", "left_anti")
    for end, at in (("b", "a"), ("a", "b")):
        wrong = wrong.join(sure.select("row_id", F.col(at).alias(end)), ["row_id", end], "left_anti").select("row_id", "a", "b", "defect", "repair")
    wrong = checkpointed(wrong)
    digits = parts.where("tag = 'page'").select("row_id", F.inline("odd")).select("row_id", "a", "b", F.lit("misread").alias("defect"), F.col("v").alias("repair"))
    # what context reads as a word is no number
    digits = digits.join(wrong.select("row_id", "a", "b"), ["row_id", "a", "b"], "left_anti")
    split = halves.select("row_id", "a", "b", F.lit("hyphenation").alias("defect"), F.lit("").alias("repair"))
    gone = furniture(df, parts, key, text, page).withColumn("repair", F.lit(None).cast("string"))
    return wrong.unionAll(digits).unionAll(split).unionByName(gone)


def _cased(seen: str, word: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if seen[:1].isupper() else word


_NOISE = re.compile(r"^[^\w\n]{4,}$|^([^\s])\1{7,}$")


def mend(text: str, marks: list[dict]) -> str:
    """A page's text with its marks undone, as paragraphs of one line each."""
    parts, at = [], 0
    for m in sorted(marks, key=lambda m: (m["a"], -m["b"])):
        if m["a"] < at:
            continue
        parts.append(text[at : m["a"]])
        if m["repair"] is not None:
            parts.append(_cased(text[m["a"] : m["b"]], m["repair"]) if m["defect"] == "misread" else m["repair"])
        at = m["b"]
    whole = "".join([*parts, text[at:]])
    paragraphs, lines = [], []
    for line in [*whole.split("\n"), ""]:
        line = line.strip()
        if not line:
            if lines:
                paragraphs.append(re.sub(r"\s+", " ", " ".join(lines)))
            lines = []
        elif not _NOISE.match(line):
            lines.append(line)
    return "\n\n".join(paragraphs)


def repaired(df: DataFrame, key: str = "row_id", text: str = "text", path: str = "relative_path", page: str = "page_number") -> DataFrame:
    """row_id and text of every page as continuous paragraphs; a null text stays null."""

    @F.pandas_udf("string")
    def mended(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mend(t, [] if m is None else list(m)) for t, m in zip(texts, marks, strict=True)], dtype=object)

    # a page has at most as many marks as code points, so the list is bounded by the text it joins
    marks = defects(df, key, text, path, page).groupBy("row_id").agg(F.collect_list(F.struct("a", "b", "defect", "repair")).alias("marks"))
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.join(marks, "row_id", "left").select("row_id", mended("text", "marks").alias("text"))

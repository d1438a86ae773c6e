"""Finding personal information in free text and replacing it by typed placeholders.

What has a form of its own (mail addresses, telephone numbers, identity numbers, postal addresses) is read by
its form. Names have none, so how much a candidate discloses is estimated from the corpus, in bits:

- Given names are learned: of two capitalised words after a form of address, the one that keeps company with
  more different partners is the given name. A list of common ones (``names.GIVEN``) adds to them, so that small
  corpora have enough; ``listed=False`` leaves it out.
- The words before a candidate, and its distinctive term, each give the information that a person stands there:
  log2 of how much likelier a person (a form of address or a given name beside it) is found with them than
  anywhere. A candidate's own standing never counts for itself.
- So does its form (a form of address before it, a given name or an initial beside it, or neither): log2 of how
  much oftener candidates of the form are borne out elsewhere (by their term or their context) than others.

A candidate whose bits together exceed the threshold is a name, whatever its form; no form is let through
without them. Mentions are then removed, each generalised to its type by a placeholder; all other text stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.names import GIVEN, edits, fold, is_given, near_given
from lectern.session import checkpointed, spread

#: Bits a candidate must disclose to be removed: at 0 a person is as likely there as anywhere.
BITS = 0.0
#: Times a word must stand after forms of address, and its share of those places as the one with more partners.
LEAST_SEEN, GIVEN_SHARE = 3, 0.7
#: The listed given names, without hyphens.
LISTED = sorted({g.replace("-", "") for g in GIVEN})
#: Parts a frequent term or context is split into when its candidates meet its counts.
SALTS = 8
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# A digit as recognisers may render it, a gap inside a mention, and a word that may be broken over a line end.
_D = r"[0-9OoIlSB]"
_GAP = r"[^\S\n]*\n?[^\S\n]*"
_BREAK = r"(?:[-‐¬­][^\S\n]*\n[^\S\n]*\w+)?"
_UP = r"[A-ZÀ-ÖØ-Þ]"

EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9_][\w+-]*(?:\.[\w+-]+)*[^\S\n]?\n?[^\S\n]?(?:@|\(at\)|\[at\]|\{at\}|\(@\))[^\S\n]?\n?[^\S\n]?[A-Za-z0-9]+(?:-\n?[A-Za-z0-9]+)*\.\n?[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:\.[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)*",
    re.IGNORECASE,
)
AHV = re.compile(rf"(?<![\w.])7[5S]6(?:{_GAP}\.?{_GAP}){_D}{{4}}(?:{_GAP}\.?{_GAP}){_D}{{4}}(?:{_GAP}\.?{_GAP}){_D}{{2}}(?!\w)")
NIR = re.compile(rf"(?<![\w.])[12](?:{_GAP}{_D}{{2}}){{3}}(?:{_GAP}{_D}{{3}}){{2}}{_GAP}{_D}{{2}}(?!\w)")
DOCUMENT = re.compile(rf"(?<![\w-])[A-Z]\d{_D}{{5}}\d(?!\w)")
_SEP = r"(?:[^\S\n]?\n?[^\S\n]?[./-]?[^\S\n]?\n?[^\S\n]?)"
PHONE = re.compile(rf"(?<![\w.+/-])(?:(?:\+|00){_SEP}{_D}{{2}}{_SEP}(?:\(0\){_SEP})?{_D}(?:{_SEP}{_D}){{8}}|(?:\(0{_D}{{2}}\)|0{_D})(?:{_SEP}{_D}){{7,8}})(?!\w)")
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}")

# Words that open the name of a street, and words and endings that close it.
STREETS = ["rue", "avenue", "av", "chemin", "ch", "route", "rte", "place", "pl", "impasse", "imp", "ruelle", "boulevard", "bd", "bvd", "quai", "allée", "all", "cours", "passage", "sentier", "square", "esplanade", "montée", "promenade"]
_STREET = "|".join(STREETS)
_WORD = rf"[\wÀ-ÿ'’.]+(?:-[\wÀ-ÿ'’]+)*{_BREAK}"
_HOUSE = rf"{_D}{{1,4}}(?:\s?(?:bis|ter|quater)\b|\s?[A-Za-z]\b)?"
_TOWN = rf"(?:(?:CH|F|D|FR|DE)-\s?)?{_D}{{4,5}}\s+(?:(?:Le|La|Les|St|Saint|Ste)\s)?{_UP}[\wÀ-ÿ'’]+(?:-[\wÀ-ÿ'’]+)*{_BREAK}"
_COMMA = r"(?:\s?[,;]\s?|\s[-–—]\s)"
_LINK = r"(?:(?:d[eucn]|des|dcs|d['’]|la|le|les|l['’]|ciu|clu|cle)\s?)"
ADDRESS = re.compile(
    rf"(?<![\w,.])(?:{_HOUSE}\s?,?\s+(?:(?:{_STREET})\b\.?|[a-zà-ÿ0-9]{{2,9}}\.?)\s+(?:{_LINK}\s*){{0,3}}{_WORD}(?:\s{_UP}{_WORD}){{0,2}}{_COMMA}{_TOWN}"
    rf"|{_HOUSE}\s?,?\s+{_WORD}(?:\s{_WORD}){{0,2}}\s(?:Road|Street|Avenue|Lane|Drive|Square|R[o0]a[dcl]+){_COMMA}{_TOWN}"
    rf"|(?i:{_STREET})\b\.?\s+(?:{_LINK}\s*){{0,3}}{_WORD}(?:\s{_UP}{_WORD}){{0,2}}\s+{_HOUSE}{_COMMA}{_TOWN}"
    rf"|{_UP}[\wÀ-ÿ.]{{1,10}}\s+(?:{_LINK}\s*){{1,3}}{_UP}?{_WORD}\s+{_HOUSE}{_COMMA}{_TOWN}"
    rf"|{_UP}{_WORD}(?:str[ao]ss?e|straße|gasse|weg|platz|str\.)(?<=\w)\s+{_HOUSE}{_COMMA}{_TOWN}"
    rf"|{_UP}[\wÀ-ÿ]*(?:[-‐¬]\n)?st[rn][\wÀ-ÿ]{{0,5}}{_BREAK}\s+{_HOUSE}{_COMMA}{_TOWN})"
)

# Forms of address.
TITLES = ["M.", "Mr", "Mr.", "MM.", "Mme", "Mme.", "Mlle", "Monsieur", "Madame", "Mademoiselle", "Dr", "Dr.", "Dre", "Docteur", "Doctoresse", "Prof.", "Professeur", "Pr", "Me", "Maître", "Herr", "Herrn", "Frau", "Mrs", "Mrs.", "Ms", "Ms."]
_TITLE_SET = frozenset(TITLES)
_LONG_TITLES = [t for t in TITLES if len(t) >= 5]
_T = rf"(?:{_UP}[\wÀ-ÿ'’]+(?:-\n?{_UP}[\wÀ-ÿ'’]*)*{_BREAK})"
_I = rf"(?:{_UP}\.(?:[-\s]?{_UP}\.)?)"
_TOKEN = re.compile(rf"{_I}(?!\w)|{_T}|{_UP}(?!\w)")
_INITIAL, _POINTED = re.compile(rf"{_I}|{_UP}"), re.compile(_I)
_AND = re.compile(r"\s*,?\s*(?:et|and|und|ct|e1)\s+")
_WORDS = re.compile(r"\w[\w'’-]*|[:,;(.\[]")
_SPACE = re.compile(r"\s+")
_NEXT = re.compile(r"[^\S\n]*\n?[^\S\n]*")
_COMMA_NEXT = re.compile(r",[^\S\n]*\n?[^\S\n]*")


@lru_cache(maxsize=100_000)
def _plain(word: str) -> str:
    return fold(re.sub(r"[-‐¬­]\s*\n\s*", "", word)).replace("0", "o").replace("1", "l").strip(".'’")


_TITLE = re.compile(rf"[^\s,;:()\[]+{_BREAK}")


@lru_cache(maxsize=100_000)
def _titled(word: str) -> bool:
    """Whether a word is a form of address, whole or broken over a line end, or misread in a sign or two."""
    if word in _TITLE_SET:
        return True
    whole = re.sub(r"[-‐¬­]\s*\n\s*", "", word).replace("rn", "m").replace("ii", "u").replace("1", "i").replace("0", "o")
    return len(whole) >= 5 and any(abs(len(t) - len(whole)) <= 2 and edits(whole, t) <= (2 if len(t) > 7 else 1) for t in _LONG_TITLES)


def _phone(match: str) -> bool:
    """Whether digits are grouped as a telephone number's are, and not as a date's."""
    if _DATE.match(match):
        return False
    digits = re.sub(r"\(0\)", "", match)
    groups = [len(g) for g in re.findall(rf"{_D}+", digits)]
    total = sum(groups)
    if match.lstrip().startswith(("+", "00")):
        return total in (11, 13)
    return total == 10 and (groups[0] in (2, 3, 10) or len(groups) <= 2)


def _name_at(text: str, at: int, sure: bool, is_given: Callable[[str], bool], near: Callable[[str], bool]) -> tuple[int, str, str] | None:
    """The name that starts at a place: its end, its distinctive term, and its shape: given (with a known given
    name), initial, or alone. sure: a person stands here, so terms near a given name count as one."""
    m = _TOKEN.match(text, at)
    if not m:
        return None
    known = (lambda w: is_given(w) or near(w)) if sure else is_given
    one, end = m.group(), m.end()
    first = _plain(one)
    c = _COMMA_NEXT.match(text, end)
    if c and not one.endswith("."):
        n = _TOKEN.match(text, c.end())
        if n and known(_plain(n.group())) and not known(first):
            return n.end(), first, "given"
    g = _NEXT.match(text, end)
    n = _TOKEN.match(text, g.end()) if g and g.end() > end else None
    initial = _INITIAL.fullmatch(one) is not None
    if n:
        two, second = n.group(), _plain(n.group())
        if _titled(two) or one in _TITLE_SET:
            n = None
        elif _POINTED.fullmatch(two):
            h = _NEXT.match(text, n.end())
            if not sure and h.end() > n.end() and _TOKEN.match(text, h.end()):
                return None  # the initial belongs to what follows
            if not initial and text[n.end() : n.end() + 1] != "\n":
                return n.end(), first, "initial"
        elif initial:
            return (n.end(), second, "initial") if len(two) > 1 and one.endswith(".") else None
        else:
            a, b = known(first), known(second)
            if a or b:
                h = _NEXT.match(text, n.end())
                o = _TOKEN.match(text, h.end()) if h and h.end() > n.end() else None
                if b and not a and o and not sure and not one.isupper() and not _titled(o.group()):
                    return None  # the given name belongs to what follows
                if o and "\n" not in text[n.end() : h.end()]:
                    third = _plain(o.group())
                    if (is_given(f"{first}-{second}") and not known(third)) or (is_given(f"{second}-{third}") and not a):
                        return o.end(), first if not a else third, "given"
                if not (a and b and "\n" in text[end : g.end()]):
                    return n.end(), second if a and not (b and one.isupper()) else first, "given"
    if initial:
        return None
    return end, first, "alone"


@lru_cache(maxsize=100_000)
def _context_word(word: str) -> str:
    return re.sub(r"\d+", "9", fold(word))


def _before(text: str, at: int) -> str:
    """The last two words or marks before a place, folded, digits alike."""
    start = at
    for _ in range(3):  # a blank more than two words back at least
        start = max(text.rfind(" ", 0, max(0, start - 1)), text.rfind("\n", 0, max(0, start - 1)), 0)
    return " ".join(map(_context_word, _WORDS.findall(text[start:at])[-2:]))


_MAIL_SIGN = re.compile(r"@|\(at\)|\[at\]|\{at\}", re.IGNORECASE)
_TOWN_SIGN = re.compile(rf"{_D}{{4}}\s+{_UP}")


def candidates(text: str, learned: frozenset[str] = frozenset(), listed: bool = True) -> list[tuple[str, int, int, str, str, str]]:
    """Mentions by form, and possible names, as (kind, start, end, context, term, form); form is titled after a form
    of address, given for a known given name beside another, initial, alone, or empty for what is no name.
    learned: given names of the corpus; listed: whether those of the list are known too."""
    out: list[tuple[str, int, int, str, str, str]] = []
    taken: list[tuple[int, int]] = []  # apart from one another and in order

    def known_given(w: str) -> bool:
        return w in learned or (listed and is_given(w))

    def near(w: str) -> bool:
        return listed and near_given(w)

    def free(a: int, b: int) -> bool:
        i = bisect_right(taken, (a, b))
        return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)

    forms = [("id_number", AHV), ("id_number", NIR), ("id_number", DOCUMENT), ("phone", PHONE)]
    if _TOWN_SIGN.search(text):
        forms.insert(3, ("address", ADDRESS))
    if _MAIL_SIGN.search(text):
        forms.insert(0, ("email", EMAIL))
    for kind, pattern in forms:
        for m in pattern.finditer(text):
            a, b = m.span()
            if not free(a, b) or (kind == "phone" and not _phone(m.group())):
                continue
            if kind != "email" and sum(c.isdigit() for c in m.group()) * 4 < 3 * sum(bool(re.match(_D, c)) for c in m.group()) and kind != "address":
                continue
            insort(taken, (a, b))
            out.append((kind, a, b, "", "", ""))
    last = -1
    at = 0
    while m := _TOKEN.search(text, at):
        a = m.start()
        at = m.end()
        if (a and (text[a - 1].isalnum() or text[a - 1] in "-'’@.+")) or not free(a, m.end()):
            if a and text[a - 1] in "'’" and free(a, m.end()):
                pass
            else:
                continue
        start, sure = a, False
        word = m.group()
        # forms of address, one or several, lead to the name
        while True:
            w = _TITLE.match(text, start)
            if not w or not _titled(w.group()):
                break
            g = _NEXT.match(text, w.end())
            if g.end() == w.end() or not _TOKEN.match(text, g.end()):
                break
            start, sure = g.end(), True
        context = _before(text, a)
        if last >= 0 and _AND.fullmatch(text, last, a):
            context = "<name> et"
        found = _name_at(text, start, sure or context == "<name> et", known_given, near)
        if not found or not free(start, found[0]):
            at = max(at, start)
            continue
        end, term, shape = found
        if sure and word == text[start:end] and not free(start, end):
            continue
        form = "titled" if sure else shape
        if form == "alone" and (known_given(term) or len(term) < 3):
            last, at = end, max(m.end(), start)
            continue
        out.append(("name", start, end, context, term, form))
        last = -1 if form == "alone" else end
        at = max(m.end(), start) if form == "alone" else end
    return out


def _terms(df: DataFrame) -> DataFrame:
    """Of rows (row_id, text): pairs (x, y, first, n) of capitalised words after a form of address, first where x is
    the given name by its writing; counts (x, n) of texts with a capitalised word, both without row_id; and rows
    (row_id, x) of words that stand beside another capitalised one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            c: Counter[tuple[str, str, bool]] = Counter()
            texts: Counter[str] = Counter()
            out: list[tuple] = []
            for k, t in frame.itertuples(index=False, name=None):
                if not isinstance(t, str):
                    continue
                for m in _TITLED_PAIR.finditer(t):
                    x, y = m.group(1), m.group(2)
                    c[_plain(x), _plain(y), not x.isupper() or y.isupper()] += 1
                texts.update({_plain(w) for w in set(_CAPITALISED.findall(t))})
                beside = {w for m in _PAIR.finditer(t) for w in m.groups()}
                out.extend((k, x, None, None, 1) for x in {_plain(w) for w in beside})
            out.extend((None, x, y, first, n) for (x, y, first), n in c.items())
            out.extend((None, x, None, None, n) for x, n in texts.items())
            yield pd.DataFrame(out, columns=["row_id", "x", "y", "first", "n"]).astype({"row_id": "Int64", "first": "boolean"})

    return df.mapInPandas(run, "row_id bigint, x string, y string, first boolean, n bigint")


_AFTER = r"(?:[^\S\n]*\n?[^\S\n]*|,\s*)"
_TITLED_PAIR = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})(?:[^\S\n]+\n?|\n)[^\S\n]*({_T}){_AFTER}({_T})(?!\w)")
_CAPITALISED = re.compile(_T)
_PAIR = re.compile(rf"(?<!\w)({_T})(?:[^\S\n]+\n?[^\S\n]*|\n[^\S\n]*|,\s*)(?=({_T}))")


def given_names(terms: DataFrame, listed: bool = True, least: int = LEAST_SEEN, share: float = GIVEN_SHARE) -> DataFrame:
    """Given names (x) learned from the rows of _terms.

    Of the two words of a pair the one whose partners carry more information (their entropy, in bits) is the given
    name; within half a bit of each other the one with its place and writing is, and one listed is before one that
    isn't. A word is learned that is the given name in ``share`` of its pairs, at least ``least`` times, and that
    is capitalised mostly because it is a name: it stands in such pairs as often as in a tenth of the texts it is in.
    """
    one = terms.where("y is not null and x <> y").groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("k"))
    one = checkpointed(one)
    sides = one.select("x", "n").unionAll(one.select("y", "n"))
    entropy = checkpointed(sides.groupBy("x").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h")))
    of = lambda c: entropy.select(F.col("x").alias(c), F.col("h").alias("of_" + c))
    both = one.join(of("x"), "x").join(of("y"), "y")
    far = F.col("of_x") - F.col("of_y")
    for_x = F.when(far > 0.5, F.col("n")).when(far < -0.5, F.lit(0)).otherwise(F.col("k"))
    if listed:
        x, y = (F.regexp_replace(c, "-", "").isin(LISTED) for c in ("x", "y"))
        for_x = F.when(x & ~y, F.col("n")).when(y & ~x, F.lit(0)).otherwise(for_x)
    votes = both.select(F.explode(F.array(F.struct("x", "n", for_x.alias("v")), F.struct(F.col("y").alias("x"), "n", (F.col("n") - for_x).alias("v")))).alias("s")).select("s.*")
    chosen = votes.groupBy("x").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where((F.col("v") >= least) & (F.col("v") >= F.col("n") * share))
    texts = terms.where("row_id is null and y is null").groupBy("x").agg(F.sum("n").alias("texts"))
    return chosen.join(texts, "x").where(F.col("n") * 10 >= F.col("texts")).select("x")


def read(df: DataFrame, key: str = "row_id", text: str = "text", listed: bool = True) -> DataFrame:
    """Candidates of every text: row_id, kind, a, b, found, context, term, form, offsets in code points."""
    rows = spread(df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")))
    terms = checkpointed(_terms(rows))
    learned = given_names(terms, listed)
    # words of a text are as many as it has, so the list is bounded by the text it joins
    own = terms.where("row_id is not null").join(learned, "x", "left_semi").groupBy("row_id").agg(F.collect_set("x").alias("learned"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (k, kind, a, b, _SPACE.sub(" ", t[a:b]), context, term, form)
                for k, t, known in frame.itertuples(index=False, name=None)
                if isinstance(t, str)
                for kind, a, b, context, term, form in candidates(t, frozenset() if known is None else frozenset(known), listed)
            ]
            yield pd.DataFrame(out, columns=["row_id", "kind", "a", "b", "found", "context", "term", "form"])

    return rows.join(own, "row_id", "left").select("row_id", "text", "learned").mapInPandas(
        run, "row_id bigint, kind string, a int, b int, found string, context string, term string, form string"
    )


def disclosed(possible: DataFrame) -> DataFrame:
    """Bits of every combination (context, term, form) among candidates: context_bits, term_bits, form_bits, bits,
    with n, how many candidates have it."""
    groups = checkpointed(possible.groupBy("context", "term", "form").agg(F.count("*").alias("n")))
    person = F.col("form").isin("titled", "given").cast("double")
    base = groups.agg((F.sum(person * F.col("n")) / F.sum("n")).alias("base"))  # one row

    def bits(by: str) -> Column:
        """Of a term or context, one candidate of the group itself left out."""
        rate = (F.col(f"{by}_hits") - person + F.col("base")) / F.col(f"{by}_seen")
        return F.log2(rate / F.col("base"))

    met = groups
    for by in ("context", "term"):
        counts = groups.groupBy(by).agg(F.sum("n").alias(f"{by}_seen"), F.sum(person * F.col("n")).alias(f"{by}_hits"))
        counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        other = "term" if by == "context" else "context"
        met = met.withColumn("salt", F.pmod(F.xxhash64(other, "form"), F.lit(SALTS)).cast("int")).join(counts, [by, "salt"]).drop("salt")
    met = met.join(F.broadcast(base)).where("base > 0")
    met = checkpointed(met.select("context", "term", "form", "n", bits("context").alias("context_bits"), bits("term").alias("term_bits"), (F.col("term_hits") - person > 0).alias("again")))
    # a form is borne out by a term found with a person elsewhere, or by a context that speaks for one
    out = ((F.col("again")) | (F.col("context_bits") >= 1)).cast("double")
    forms = met.groupBy("form").agg(F.sum("n").alias("all"), F.sum(out * F.col("n")).alias("out"))  # as many rows as forms
    whole = met.agg(((F.sum(out * F.col("n")) + 0.5) / (F.sum("n") + 1)).alias("whole"))  # one row
    forms = forms.join(F.broadcast(whole)).select("form", F.log2((F.col("out") + F.col("whole")) / (F.col("all") + 1) / F.col("whole")).alias("form_bits"))
    return met.drop("again").join(F.broadcast(forms), "form").withColumn("bits", F.col("context_bits") + F.col("term_bits") + F.col("form_bits"))


def mentions(df: DataFrame, key: str = "row_id", text: str = "text", bits: float = BITS, listed: bool = True) -> DataFrame:
    """Mentions of personal information: row_id, kind, a, b (offsets in code points), found.

    Null and empty texts have none. Keys are unique. Other columns are dropped, so names cannot clash. An empty
    table gives no rows; in a table where no form of address and no given name stands, no name is told from other words.
    """
    every = checkpointed(read(df, key, text, listed))
    possible = every.where("kind = 'name'")
    names = possible.join(disclosed(possible).where(F.col("bits") >= bits).select("context", "term", "form"), ["context", "term", "form"], "left_semi")
    columns = ["row_id", "kind", "a", "b", "found"]
    return every.where("kind <> 'name'").select(columns).unionAll(names.select(columns))


def decided(df: DataFrame, key: str = "row_id", text: str = "text", bits: float = BITS, listed: bool = True) -> DataFrame:
    """What disclosure decides about possible names, by form: candidates, removed (names), kept (stay as text)."""
    met = disclosed(checkpointed(read(df, key, text, listed).where("kind = 'name'")))
    name = (F.col("bits") >= bits).cast("bigint")
    return met.groupBy("form").agg(F.sum("n").alias("candidates"), F.sum(F.col("n") * name).alias("removed"), F.sum(F.col("n") * (1 - name)).alias("kept"))


def redact(df: DataFrame, key: str = "row_id", text: str = "text", **how: object) -> DataFrame:
    """row_id and text with every mention replaced by its placeholder; a null text stays null. key is unique."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, marks in zip(texts, spans, strict=True):
            if t is None or marks is None:
                out.append(t)
                continue
            parts, at = [], 0
            for m in sorted(marks, key=lambda m: (m["a"], -m["b"])):
                if m["a"] >= at:
                    parts += [t[at : m["a"]], PLACEHOLDERS[m["kind"]]]
                    at = m["b"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    # a text holds fewer mentions than code points, so the list is bounded by the text it joins
    found = mentions(df, key, text, **how).groupBy("row_id").agg(F.collect_list(F.struct("a", "b", "kind")).alias("spans"))
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.join(found, "row_id", "left").select("row_id", replaced("text", "spans").alias("text"))

"""Linking the spellings of persons and organisations as people typed them.

A surface is read into parts: a person's surname and given name (or initials), an organisation's kind and its
distinctive core. Candidates come from blocks keyed by the phonetic codes of the sorted distinctive tokens;
each code also stands under itself less one sign, so one slip leaves a key in common. Within a block parts are
compared by Jaro-Winkler similarity and edit distance, given names also through a table of short forms and
initials, kinds of organisations through abbreviations. Accepted pairs of full names are clustered by
connected components; where a component holds names known to differ, each name goes with the likest of them. A name in part (an initial, a surname or a core alone) joins the one cluster it fits,
and none if it fits several. Links made earlier (entity_id) hold apart what they name differently.

Comparisons are between different surfaces, never between rows, so a name in a third of all rows costs as much
as any other.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

# Titles and forms of address.
TITLES = ["m", "mr", "mme", "mlle", "monsieur", "madame", "mademoiselle", "dr", "dre", "docteur", "doctoresse", "prof", "pr", "professeur", "me", "maitre", "herr", "frau", "mrs", "ms"]
# Common given names of the languages at hand.
GIVEN = """
adrien agnes alain albert alexandra alexandre alice aline amelie andre anna anne anne-laure anne-lise anne-marie anne-sophie antoine
arnaud arthur audrey aurelie beatrice benjamin benoit bernard brigitte bruno camille carole caroline catherine cecile cedric celine
chantal charles charlotte chloe christelle christian christine christophe claire claude claudine clement corinne daniel david delphine
denis denise didier dominique edith edmond edouard elisabeth elise emilie emma emmanuel eric estelle etienne eugene fabienne fabrice
felix florence florian francis francois francoise frederic gabriel gaelle genevieve georges gerard gilbert gilles gregoire guillaume
guy helene henri hugo ingrid irene iris isabelle jacqueline jacques jean jean-claude jean-luc jean-marc jean-pierre jerome joel josephine
jules julie julien justine karine laura laurence laurent lea leon leo loic louis louise luc lucas lucie madeleine magali manon marc
marc-antoine marguerite maria marie marie-claude marine marion martin martine mathieu matthieu maurice maxime melanie michel michele
mireille monique muriel murielle nadine nathalie nicolas nicole noemie odile olivier pascal pascale patricia patrick paul peter philippe
pierre pierre-alain quentin rachel raphael raymond regine remy renee robert roger roland romain sabine samuel sandrine sarah sebastien simon
simone solange solveig sophie stefan stephane stephanie suzanne sylvain sylvie tatiana theo therese thibault thierry thomas ulysse ursula
valerie veronique victor vincent violaine virginie viviane walter william xavier yannick yves yvette yvonne
""".split()  # fmt: skip
# Short forms and the given names they stand for.
SHORT = {
    "alex": "alexandre alexandra", "anto": "antoine", "toine": "antoine", "bea": "beatrice", "ben": "benjamin benoit", "benji": "benjamin", "bernie": "bernard",
    "cam": "camille", "caro": "caroline carole", "cath": "catherine", "cathy": "catherine", "ced": "cedric", "chris": "christelle christian christine christophe",
    "coco": "corinne", "dan": "daniel", "del": "delphine", "did": "didier", "dom": "dominique", "domi": "dominique", "ed": "edmond edouard", "eli": "elisabeth", "babeth": "elisabeth",
    "flo": "florence florian", "fab": "fabrice fabienne", "fabi": "fabienne", "fred": "frederic", "franck": "francois", "fanfan": "francois francoise", "gab": "gabriel", "gaby": "gabriel", "gege": "gerard",
    "gen": "genevieve", "ginou": "genevieve", "greg": "gregoire", "gui": "guillaume", "guigui": "guillaume", "isa": "isabelle", "jacquie": "jacqueline", "jacky": "jacques", "jo": "joel josephine", "jojo": "joel josephine", "josy": "josephine", "je": "jerome",
    "jerem": "jerome", "juju": "julien justine", "jp": "jean-pierre", "jl": "jean-luc", "kari": "karine", "lolo": "laurent loic louise", "loulou": "louise lucas", "lulu": "lucas louise", "mado": "madeleine", "mag": "magali marguerite", "mago": "magali marguerite", "margot": "marguerite", "manu": "emmanuel",
    "mary": "marie marion", "mat": "mathieu", "math": "mathieu", "max": "maxime", "mel": "melanie", "mich": "michel", "mimi": "michel murielle emilie", "momo": "monique", "mumu": "murielle muriel",
    "nath": "nathalie", "nico": "nicolas", "no": "noemie", "nono": "noemie", "oli": "olivier", "pat": "patricia patrick", "patou": "patricia", "phil": "philippe", "pierrot": "pierre pierre-alain jean-pierre", "pa": "pierre-alain", "quen": "quentin",
    "raph": "raphael", "rach": "rachel", "rom": "romain", "riri": "henri", "sab": "sabine", "sam": "samuel", "sandy": "sandrine", "sand": "sandrine", "seb": "sebastien", "sol": "solange solveig", "sophie": "anne-sophie", "steph": "stephanie stephane", "syl": "sylvain sylvie", "sylv": "sylvain sylvie", "uschi": "ursula",
    "tati": "tatiana", "tess": "therese", "theo": "theophile", "titi": "thibault", "tib": "thibault", "val": "valerie", "vero": "veronique", "vince": "vincent", "vio": "violaine", "will": "william", "bill": "william", "yan": "yannick", "yann": "yannick", "vonette": "yvonne",
}
# Words that say what kind an organisation is of, and legal forms.
KINDS = [
    "assurance", "association", "atelier", "banque", "cabinet", "caisse", "centre", "clinique", "compagnie", "dentaire", "ecole", "editions", "etude", "fiduciaire", "fondation", "garage", "hopital", "hospitalier",
    "imprimerie", "institut", "laboratoire", "maison", "maladie", "medical", "pharmacie", "radiologie", "service", "societe", "soins", "spital", "praxis", "apotheke", "krankenkasse", "stiftung",
]
LEGAL = ["sa", "sas", "sarl", "scm", "sci", "snc", "ag", "gmbh", "cie", "co", "ltd", "et", "und"]
JOINING = ["de", "du", "des", "la", "le", "les", "d", "l", "the", "of"]
#: Similarity two surnames or cores need besides at most one edit (two from ten letters on).
LEAST = 0.84
#: Letters of the shortest token that may differ by an edit; tokens of one or two letters are initials or codes.
SHORTEST = 3
#: Surfaces of a block that one task compares with all others of it.
COMPARED = 500
#: Links of the largest component that one task settles; larger ones are settled in rounds over all tasks.
LARGEST = 200_000


def fold(text: str) -> str:
    text = text.replace("œ", "oe").replace("æ", "ae").replace("ß", "ss").replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def code(word: str) -> str:
    """Phonetic code of a folded word: sounds alike in French under one sign, vowels dropped, repeats once."""
    w = re.sub(r"[^a-z]", "", word)
    for a, b in (("ph", "f"), ("sch", "j"), ("ch", "j"), ("sh", "j"), ("qu", "k"), ("ge", "je"), ("gi", "ji"), ("gy", "ji"), ("ce", "se"), ("ci", "si"), ("cy", "si"), ("gn", "n")):
        w = w.replace(a, b)
    w = re.sub(r"[ck]+|q", "k", w).translate(str.maketrans("zwdbg", "svtpk"))
    head = w[:1] if w[:1] and w[:1] not in "aeiouyh" else ("a" if w else "")
    tail = re.sub(r"[aeiouyh]", "", w[1:])
    return re.sub(r"(.)\1+", r"\1", head + tail)


def keys(c: str) -> list[str]:
    """A code and the code less one sign anywhere."""
    return sorted({c} | {re.sub(r"(.)\1+", r"\1", c[:i] + c[i + 1 :]) for i in range(len(c)) if len(c) > 2})


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits between words, a swap of neighbours counting as one; most + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """Similarity of two surnames or cores, 0 where they aren't the same but for a slip."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < SHORTEST or edits(a, b) > (1 if min(len(a), len(b)) < 10 else 2):
        return 0.0
    score = jaro_winkler(a, b)
    return score if score >= LEAST else 0.0


_GIVEN = frozenset(GIVEN)
_BARE_GIVEN = {g.replace("-", ""): g for g in GIVEN}


@lru_cache(maxsize=100_000)
def given_names(word: str) -> frozenset[str]:
    """Given names a word may stand for: itself, what it is short for, or a known one a slip away."""
    bare = word.replace("-", "").replace(" ", "")
    if bare in _BARE_GIVEN:
        own = {_BARE_GIVEN[bare]}
    else:
        own = {word}
        if bare not in SHORT and len(bare) >= 4:
            own |= {g for b, g in _BARE_GIVEN.items() if abs(len(b) - len(bare)) <= 1 and edits(b, bare, 1) <= 1}
    return frozenset(own | set(SHORT.get(bare, "").split()))


def is_given(word: str) -> bool:
    bare = word.replace("-", "")
    return bare in _BARE_GIVEN or bare in SHORT


def near_given(word: str) -> bool:
    return len(given_names(word)) > 1


_INITIALS = re.compile(r"(?:[^\W\d_]\.?(?:[-\s]?[^\W\d_]\.)*|(?:[^\W\d_]\.-?)+)\Z")


def read_person(surface: str) -> tuple[str, str, str]:
    """(surname, given, form): form full, short (given is initials or a clipped name), or alone."""
    text = re.sub(r"\s+", " ", surface.strip())
    comma = [p.strip() for p in text.split(",")] if text.count(",") == 1 else None
    tokens = text.replace(",", " ").split()
    if not tokens:
        return "", "", "alone"
    titled = False
    while len(tokens) > 1 and fold(tokens[0]).rstrip(".") in TITLES and (len(tokens[0].rstrip(".")) > 1 or tokens[0] == "M."):
        tokens, titled = tokens[1:], True
    if comma and not titled and all(comma):
        first, second = comma
        return fold(first).replace(" ", ""), *_given(second)
    if len(tokens) == 1:
        return fold(tokens[0]).rstrip("."), "", "alone"
    if len(tokens) > 2:
        # a given name of two words, written without its hyphen, at either end
        for cut in (2, len(tokens) - 2):
            pair = tokens[:2] if cut == 2 else tokens[-2:]
            rest = tokens[2:] if cut == 2 else tokens[:-2]
            if rest and "-".join(map(fold, pair)) in _GIVEN:
                return fold("".join(rest)), "-".join(map(fold, pair)), "full"
    head, tail = tokens[0], " ".join(tokens[1:])
    last, front = tokens[-1], " ".join(tokens[:-1])
    if _INITIALS.match(head) and not _INITIALS.match(tail):
        return fold(tail).replace(" ", ""), *_given(head)
    if _INITIALS.match(last):
        return fold(front).replace(" ", ""), *_given(last)
    a, b = fold(head).rstrip("."), fold(last).rstrip(".")
    if len(tokens) == 2:
        caps = (head.isupper() and len(head) > 1, last.isupper() and len(last) > 1)
        if caps == (True, False) or last.endswith("."):
            return a, *_given(last)
        if caps == (False, True):
            return b, *_given(head)
        rank = [(is_given(w), near_given(w)) for w in (a, b)]
        if rank[1] > rank[0]:
            return a, *_given(last)
        return b, *_given(head)
    return fold(tail).replace(" ", ""), *_given(head)


def _given(word: str) -> tuple[str, str]:
    w = fold(word.strip())
    if _INITIALS.match(word.strip()):
        return ".".join(re.findall(r"[^\W\d_]", w)), "short"
    if w.endswith("."):
        w = w.rstrip(".")
        return (w, "full") if w.replace("-", "") in _BARE_GIVEN or len(w) > 5 else (w, "clipped")
    return w.replace(" ", "-"), "full"


def same_given(a: str, form_a: str, b: str, form_b: str) -> float:
    """Similarity of given names, 0 where they differ."""
    if a == b:
        return 1.0
    if form_a == "full" and form_b == "full":
        x, y = a.replace("-", ""), b.replace("-", "")
        if x in _BARE_GIVEN and y in _BARE_GIVEN:
            return float(x == y)
        if given_names(a) & given_names(b):
            return 0.97
        return 0.93 if min(len(x), len(y)) >= 3 and edits(x, y, 1) <= 1 else 0.0
    if form_a == "short" or form_b == "short":
        short, full = (a, b) if form_a == "short" else (b, a)
        letters = short.split(".")
        if "." in full or form_a == form_b:
            other = full.split(".")
            return 0.9 if letters[0] == other[0] and (len(letters) == 1 or len(other) == 1 or letters == other) else 0.0
        for name in given_names(full) | {full}:
            parts = [p[0] for p in name.split("-") if p]
            if letters == parts or (len(letters) == 1 and letters == parts[:1]):
                return 0.9
        return 0.0
    short, full = (a, b) if form_a == "clipped" else (b, a)
    return 0.92 if any(n.startswith(short) for n in given_names(full) | {full}) else 0.0


def _kind_word(token: str) -> str | None:
    """The kind word a token is, but for plural or a slip."""
    stem = token[:-1] if token.endswith("s") and len(token) > 5 else token
    for k in KINDS:
        if token == k or stem == k or (len(token) >= 5 and min(edits(token, k, 1), edits(stem, k, 1)) <= 1):
            return k
    return None


def read_organization(surface: str) -> tuple[str, str]:
    """(core, kind words joined by a space): distinctive tokens and the rest, as written but folded."""
    text = fold(surface)
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group(1).replace(".", ""), text)
    for word in KINDS:  # a kind word run together with the next
        text = re.sub(rf"\b{word}(?=(?:{'|'.join(KINDS)})\b)", word + " ", text)
    tokens = [t for t in re.findall(r"[a-z0-9]+\.?", text) if t.rstrip(".") not in LEGAL and t.rstrip(".") not in JOINING]
    kind, core = [], []
    for t in tokens:
        bare = t.rstrip(".")
        word = _kind_word(bare)
        if word:
            kind.append(word)
        elif t.endswith(".") or len(bare) <= 3 or _abbreviates(bare):
            kind.append(bare)
        else:
            core.append(bare)
    if not core and kind:
        longest = max(kind, key=len)
        if longest not in KINDS:
            kind.remove(longest)
            core = [longest]
    return " ".join(sorted(core)), " ".join(kind)


# Abbreviations of kinds that are longer than three letters and written without a point.
ABBREVIATIONS = {"labo": "laboratoire", "ctre": "centre", "pharm": "pharmacie", "fiduc": "fiduciaire", "impr": "imprimerie", "fond": "fondation", "clin": "clinique", "inst": "institut", "dent": "dentaire", "hosp": "hospitalier", "assur": "assurance", "center": "centre"}


def _abbreviates(token: str) -> bool:
    return token in ABBREVIATIONS


def _stands_for(short: str, word: str) -> bool:
    if word.startswith(short) or ABBREVIATIONS.get(short) == word:
        return True
    it = iter(word)
    return short[:1] == word[:1] and len(short) >= 2 and all(c in it for c in short)


def same_kind(a: str, b: str) -> float:
    """Similarity of kinds: 1 for equal words, less where one abbreviates or leaves out words, 0 if they differ."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.5
    x, y = a.split(), b.split()
    if len(x) > len(y) or (len(x) == len(y) and len(a) > len(b)):
        x, y = y, x
    if len(x) == 1 and len(x[0]) == len(y) and all(w[0] == c for w, c in zip(y, x[0], strict=True)):
        return 0.9
    at = 0
    for word in x:
        while at < len(y) and not (y[at] == word or _stands_for(word, y[at]) or _stands_for(y[at], word)):
            at += 1
        if at == len(y):
            return 0.0
        at += 1
    return 0.9 if len(x) == len(y) else 0.8


_READ = "surface string, n bigint, id bigint, kind string, main string, other string, form string, codes array<string>, blocks array<string>"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for surface, n, ident, person, organization, place in f.itertuples(index=False, name=None):
            if place > max(person, organization):
                continue
            core, kind = read_organization(surface)
            known = organization > person or (organization == person and any(k in KINDS for k in kind.split()))
            single = len(surface.split()) == 1
            if known or (not person and single):
                if core:
                    form = "full" if kind else "alone"
                    own = keys(" ".join(sorted(map(code, core.split()))))
                    out.append((surface, n, ident, "o", core, kind, form, own, own))
            else:
                sur, given, form = read_person(surface)
                if sur:
                    first = sorted({g[0] for g in given_names(given)} | {given[0]}) if given else ["*"]
                    own = keys(code(sur))
                    out.append((surface, n, ident, "p", sur, given, form, own, [f"{key} {x}" for key in own for x in first]))
        yield pd.DataFrame(out, columns=["surface", "n", "id", "kind", "main", "other", "form", "codes", "blocks"])


def surfaces(df: DataFrame, surface: str = "surface", type_id: str = "type_id", entity_id: str = "entity_id") -> DataFrame:
    """Different surfaces with how many rows have them, by type, and their entity where rows agree on one."""
    t = F.lower(F.col(type_id))
    return (
        df.where(F.col(surface).isNotNull())
        .groupBy(F.col(surface).alias("surface"))
        .agg(
            F.count("*").alias("n"),
            F.min(entity_id).alias("lo"),
            F.max(entity_id).alias("hi"),
            F.count_if(t == "person").alias("person"),
            F.count_if(t == "organization").alias("organization"),
            F.count_if(~t.isin("person", "organization") & t.isNotNull()).alias("place"),
        )
        .select("surface", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).cast("bigint").alias("id"), "person", "organization", "place")
    )


_PAIR = "a string, b string, score double, part_a boolean, part_b boolean, n_a bigint, n_b bigint, exact boolean, common string"


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for a, na, ia, ma, oa, fa, b, nb, ib, mb, ob, fb, kind in f.itertuples(index=False, name=None):
            if ia == ia and ib == ib and ia is not None and ib is not None and ia != ib:
                continue
            score = alike(ma, mb)
            if not score:
                continue
            other = same_kind(oa, ob) if kind == "o" else (0.5 if "alone" in (fa, fb) else same_given(oa, fa, ob, fb))
            if not other:
                continue
            part_a, part_b = fa in ("short", "alone"), fb in ("short", "alone")
            out.append((a, b, score * other, part_a, part_b, na, nb, ma == mb, f"{kind} {ma}" if ma == mb else None))
        yield pd.DataFrame(out, columns=["a", "b", "score", "part_a", "part_b", "n_a", "n_b", "exact", "common"])


def _find(parents: dict[str, str], node: str) -> str:
    """The least node joined to node so far."""
    while (up := parents.setdefault(node, node)) != node:
        parents[node] = node = parents[up]
    return node


def _join(parents: dict[str, str], a: str, b: str) -> None:
    a, b = _find(parents, a), _find(parents, b)
    parents[max(a, b)] = min(a, b)


def _roots(parents: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame([(node, _find(parents, node)) for node in list(parents)], columns=["node", "root"], dtype=object)


def _alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of links (common, a, b) that come sorted by what both ends have in common; only its nodes are held."""
    at, parents, done = None, {}, {}
    for f in frames:
        for common, a, b in f.itertuples(index=False, name=None):
            if common != at:
                done |= parents
                at, parents = common, {}
            _join(parents, a, b)
        yield _roots(done)
        done = {}
    yield _roots(done | parents)


def alike_components(edges: DataFrame) -> DataFrame:
    """components() of edges (common, a, b) where linked nodes always have common alike: a component then lies in one
    task, and no rounds are needed."""
    return edges.select("common", "a", "b").repartition("common").sortWithinPartitions("common").mapInPandas(_alike, "node string, root string")


def _may_be_alike() -> Column:
    """Whether alike() can be above 0: a swap of neighbours, one edit there, is two here. Spares the workers the other pairs."""
    shorter = F.least(F.length("main1"), F.length("main2"))
    apart = F.levenshtein("main1", "main2", 4)
    differ = (shorter >= SHORTEST) & (apart >= 0) & (apart <= F.when(shorter < 10, 2).otherwise(4))
    same_id = F.col("id1").isNull() | F.col("id2").isNull() | (F.col("id1") == F.col("id2"))
    return same_id & ((F.col("main1") == F.col("main2")) | differ)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node of its component.

    Each round every node takes the least label among its own, its neighbours' and its label's label; rounds
    go on until none changes, so no component is cut short (most_rounds only guards against a fault).
    """
    both = checkpointed(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("new"))
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("far"))
        after = checkpointed(step.join(jump, step["new"] == jump["at"]).select("node", "root", F.least("new", "far").alias("new")))
        changed = after.where("root <> new").limit(1).count()
        labels = after.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def held_apart(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b, score) without those that join what labels (node, label) tell apart.

    Only components with several labels lose any. There a node without a label takes that of the likest chain to
    a labelled one (its weakest link counts, then how few they are, then the lesser label), and links between
    nodes of different labels go. A chain grows worse with each link, so the rounds end.
    """
    labelled = components(links).join(known, "node", "left")
    mixed = labelled.groupBy("root").agg(F.countDistinct("label").alias("k")).where("k > 1").select("root")
    nodes = checkpointed(labelled.join(mixed, "root", "left_semi").select("node", "label"))
    if nodes.isEmpty():
        return links
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).join(nodes.select(F.col("node").alias("a")), "a", "left_semi"))
    seeds = nodes.where("label is not null").select("node", F.lit(1e9).alias("least"), F.lit(0).alias("far"), "label")
    state = checkpointed(seeds)
    while True:
        offers = both.join(state, both["b"] == state["node"]).select(F.col("a").alias("node"), F.least("least", "score").alias("least"), (F.col("far") + 1).alias("far"), "label")
        best = offers.groupBy("node").agg(F.max(F.struct("least", (-F.col("far")).alias("near"))).alias("x"))
        tied = offers.join(best, "node").where((F.col("least") == F.col("x.least")) & (F.col("far") == -F.col("x.near"))).groupBy("node", "least", "far").agg(F.min("label").alias("label"))
        after = checkpointed(seeds.unionByName(tied.join(seeds.select("node"), "node", "left_anti").select("node", "least", "far", "label")))
        if after.exceptAll(state).isEmpty():
            break
        state = after
    side = lambda end: after.select(F.col("node").alias(end), F.col("label").alias("label_" + end))
    return checkpointed(links.join(side("a"), "a", "left").join(side("b"), "b", "left").where("label_a is null or label_b is null or label_a = label_b").select("a", "b", "score"))


def _apart(links: list[tuple[str, str, float]], known: dict[str, str]) -> list[tuple[str, str, float]]:
    """What held_apart() does, over the links of one component or several."""
    if len(set(known.values())) < 2:
        return links
    parents: dict[str, str] = {}
    for a, b, _ in links:
        _join(parents, a, b)
    told: dict[str, set[str]] = {}
    for node, label in known.items():
        if node in parents:
            told.setdefault(_find(parents, node), set()).add(label)
    mixed = {root for root, labels in told.items() if len(labels) > 1}
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, score in links:
        if _find(parents, a) in mixed:
            near.setdefault(a, []).append((b, score))
            near.setdefault(b, []).append((a, score))
    # as a chain only grows worse, the likest open one is final
    found: dict[str, str] = {}
    chains = [(-1e9, 0, known[node], node) for node in near if node in known]
    heapq.heapify(chains)
    while chains:
        least, far, label, node = heapq.heappop(chains)
        if node in found:
            continue
        found[node] = label
        for other, score in near[node]:
            if other not in found and other not in known:
                heapq.heappush(chains, (max(least, -score), far + 1, label, other))
    return [(a, b, score) for a, b, score in links if a not in found or b not in found or found[a] == found[b]]


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of links once what identities and given names tell apart is held apart. Rows come sorted by root: links
    (a, b, score), and what is known of a node a (identity or given name)."""

    def settled() -> dict[str, str]:
        parents: dict[str, str] = {}
        for a, b, _ in _apart(_apart(links, ids), called):
            _join(parents, a, b)
        return parents

    at, links, ids, called, done = None, [], {}, {}, {}
    for f in frames:
        for root, a, b, score, ident, given in f.itertuples(index=False, name=None):
            if root != at:
                done |= settled()
                at, links, ids, called = root, [], {}, {}
            if b is not None:
                links.append((a, b, score))
            elif ident is not None:
                ids[a] = ident
            else:
                called[a] = given
        yield _roots(done)
        done = {}
    yield _roots(settled())


def settled(links: DataFrame, ids: DataFrame, called: DataFrame) -> DataFrame:
    """components() of links (a, b, score) after held_apart() by ids and then by called, both of (node, label).

    Either only takes links away, so each component is settled by one task; those of over LARGEST links go through
    held_apart() and components() themselves.
    """
    roots = components(links)
    none = F.lit(None).cast("string")
    known = ids.select("node", F.col("label").alias("ident"), none.alias("given")).unionAll(called.select("node", none, "label"))
    rows = checkpointed(
        links.join(roots.toDF("a", "root"), "a").select("root", "a", "b", "score", none.alias("ident"), none.alias("given"))
        .unionAll(roots.join(known, "node").select("root", "node", none, F.lit(None).cast("double"), "ident", "given"))
        .repartition("root").sortWithinPartitions("root")
    )
    large = rows.where("b is not null").groupBy("root").count().where(F.col("count") > LARGEST).select("root")
    if not large.isEmpty():
        large = checkpointed(large)
        kept = rows.where("b is not null").join(large, "root", "left_semi").select("a", "b", "score")
        kept = held_apart(held_apart(checkpointed(kept), ids), called)
        rows = rows.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root")
        return rows.mapInPandas(_settle, "node string, root string").unionAll(components(kept))
    return rows.mapInPandas(_settle, "node string, root string")


def met(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Pairs of a row of left and one of right, of one kind, that share a key in the array column by, each pair once: at
    the least key they share. Columns of left end in 1, those of right in 2.

    A key that many rows have is split: each part of one side meets all of the other, in a task of its own.
    """
    columns = ["surface", "n", "id", "main", "other", "form", by]
    sizes = right.select("kind", F.explode(by).alias("key")).groupBy("kind", "key").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias("parts"))
    one = left.select(*[F.col(c).alias(c + "1") for c in columns], "kind", F.explode(by).alias("key")).join(sizes, ["kind", "key"])
    two = right.select(*[F.col(c).alias(c + "2") for c in columns], "kind", F.explode(by).alias("key")).join(sizes, ["kind", "key"])
    one = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    two = two.withColumn("part", F.pmod(F.xxhash64("surface2"), "parts").cast("int")).drop("parts")
    return one.join(two, ["kind", "key", "part"]).where(F.col("key") == F.array_min(F.array_intersect(by + "1", by + "2")))


def clusters(df: DataFrame, surface: str = "surface", type_id: str = "type_id", entity_id: str = "entity_id") -> DataFrame:
    """Rows (surface, root): different surfaces and the cluster they belong to; surfaces linked to none are left out.

    A null surface is no name. A null type is guessed from the words. Repeated rows count as one surface. Other
    columns are dropped, so names cannot clash. An empty table gives no rows.
    """
    # different surfaces are few beside rows, so the runtime would put them into few partitions; reading one is dear
    each = surfaces(df, surface, type_id, entity_id).repartition(df.sparkSession.sparkContext.defaultParallelism)
    read = checkpointed(each.mapInPandas(_read, _READ))
    order = ["surface1", "n1", "id1", "main1", "other1", "form1", "surface2", "n2", "id2", "main2", "other2", "form2", "kind"]
    near = met(read, read, "blocks").where("surface1 < surface2").select(order)
    # a surname alone fits any given name, so it meets the others by its code only
    lone = met(read.where("kind = 'p' and form = 'alone'"), read.where("kind = 'p' and form <> 'alone'"), "codes").select(order)
    scored = checkpointed(near.unionByName(lone).where(_may_be_alike()).mapInPandas(_compare, _PAIR))
    full = scored.where("not part_a and not part_b")
    # equal parts link at once; the groups they make then meet as a whole
    same = alike_components(full.where("exact"))
    groups = checkpointed(
        read.where("form not in ('short', 'alone')")
        .select(F.col("surface").alias("node"), "n", "id")
        .distinct()
        .join(same, "node", "left")
        .select("node", F.coalesce("root", "node").alias("g"), "n", "id")
    )
    totals = groups.groupBy("g").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    of = groups.select("node", "g")
    near = (
        full.where("not exact")
        .join(of.toDF("a", "ga"), "a")
        .join(of.toDF("b", "gb"), "b")
        .where("ga <> gb")
        .groupBy(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"))
        .agg(F.max("score").alias("score"))
        .join(totals.toDF("ga", "na", "ia"), "ga")
        .join(totals.toDF("gb", "nb", "ib"), "gb")
        .where("ia is null or ib is null or ia = ib")
    )
    # every accepted link counts; only what links made earlier or known given names tell apart stays so
    links = checkpointed(near.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "score"))
    ids = totals.where("id is not null").select(F.col("g").alias("node"), F.col("id").cast("string").alias("label"))
    bare = F.regexp_replace("other", "-", "")
    given = read.where((F.col("kind") == "p") & (F.col("form") == "full") & bare.isin(list(_BARE_GIVEN))).select(F.col("surface").alias("node"), bare.alias("label")).distinct()
    called = given.join(of, "node").groupBy("g").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    whole = settled(links, ids, called.select(F.col("g").alias("node"), "label"))
    whole = of.join(whole.toDF("g", "root"), "g", "left").select("node", F.coalesce("root", "g").alias("root"))
    named = checkpointed(whole)
    # names in part: the clusters each fits, equal surnames before like ones
    fits = scored.where("part_a and not part_b").select(F.col("a").alias("part"), F.col("b").alias("node"), "score", "exact").unionAll(
        scored.where("part_b and not part_a").select(F.col("b"), F.col("a"), "score", "exact")
    )
    fitted = fits.join(named, "node").groupBy("part", "root").agg(F.max("exact").alias("exact"), F.max("score").alias("score"))
    sure = fitted.groupBy("part").agg(F.max("exact").alias("any_exact"))
    fitted = fitted.join(sure, "part").where(F.col("exact") == F.col("any_exact"))
    only = fitted.groupBy("part").agg(F.count("*").alias("k"), F.min("root").alias("root"))
    joined = only.where("k = 1").select("part", "root")
    # names in part that fit no full name link among themselves
    stray = scored.where("part_a and part_b and exact").select("common", "a", "b").join(only.select(F.col("part").alias("a")), "a", "left_anti").join(only.select(F.col("part").alias("b")), "b", "left_anti")
    alone = alike_components(stray)
    return named.where("node <> root").unionAll(named.select("root", "root").distinct()).toDF("surface", "root").unionAll(joined).unionAll(alone).distinct()


def pairs(df: DataFrame, **names: str) -> DataFrame:
    """All pairs (surface_a, surface_b), the smaller first, of different surfaces of one cluster."""
    own = checkpointed(clusters(df, **names))
    # as the pairs of a cluster are what is asked for, the join is by cluster and writes no more than them
    return own.toDF("surface_a", "root").join(own.toDF("surface_b", "root"), "root").where("surface_a < surface_b").select("surface_a", "surface_b").distinct()

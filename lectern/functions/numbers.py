"""Numbers and dates as people write them, as JVM expressions: shapes, units, dates, scans of running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import fold

# The units an amount may carry at either end.
UNITS = ["SFr.", "CHF", "Fr.", "€", "$", "%"]
_UNIT = r"(?:SFr\.|CHF|Fr\.|€|\$|%)"
_GAP = r"[  ' ’]"

# Month names, French, English and German, by number.
MONTHS = {
    1: "janvier january januar", 2: "fevrier february februar", 3: "mars march marz", 4: "avril april", 5: "mai may", 6: "juin june juni",
    7: "juillet july juli", 8: "aout august", 9: "septembre september", 10: "octobre october oktober", 11: "novembre november", 12: "decembre december dezember",
}


def strip_unit(c: Column) -> tuple[Column, Column]:
    """A cell without the unit at either end, and the unit (null where there is none)."""
    t = F.trim(c)
    lead, trail = F.regexp_extract(t, rf"^({_UNIT})\s*", 1), F.regexp_extract(t, rf"\s*({_UNIT})$", 1)
    unit = F.when(lead != "", lead).when(trail != "", trail)
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"^{_UNIT}\s*", ""), rf"\s*{_UNIT}$", "")), unit


def number_shape(c: Column) -> Column:
    """What a cell writes, as a struct: kind (resolved, ambiguous, invalid), value, unit, and for an ambiguous
    cell its separator. Ambiguous is one separator before exactly three digits, which may group or divide."""
    bare, unit = strip_unit(c)
    negative = bare.rlike(r"^\(.*\)$") | bare.rlike(r"^[-−]")
    core = F.regexp_replace(bare, r"^[(+\-−]\s*|\)$", "")
    tight = F.regexp_replace(core, rf"(?<=\d){_GAP}(?=\d{{3}}(?:\D|$))", "")
    sign = F.when(negative, -1.0).otherwise(1.0)
    value = (
        F.when(tight.rlike(r"^\d+$"), tight.try_cast("double"))
        .when(tight.rlike(r"^\d{1,3}(?:\.\d{3})+,\d+$"), F.replace(F.replace(tight, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))
        .when(tight.rlike(r"^\d{1,3}(?:,\d{3})+\.\d+$"), F.replace(tight, F.lit(","), F.lit("")).try_cast("double"))
        .when(tight.rlike(r"^\d{1,3}(?:\.\d{3}){2,}$"), F.replace(tight, F.lit("."), F.lit("")).try_cast("double"))
        .when(tight.rlike(r"^\d{1,3}(?:,\d{3}){2,}$"), F.replace(tight, F.lit(","), F.lit("")).try_cast("double"))
        .when(tight.rlike(r"^\d+[.,](?:\d{1,2}|\d{4,})$") | tight.rlike(r"^(?:0|\d{4,})[.,]\d{3}$"), F.replace(tight, F.lit(","), F.lit(".")).try_cast("double"))
    )
    ambiguous = tight.rlike(r"^[1-9]\d{0,2}[.,]\d{3}$")
    kind = F.when(value.isNotNull(), "resolved").when(ambiguous, "ambiguous").otherwise("invalid")
    return F.struct(kind.alias("kind"), (sign * value).alias("value"), unit.alias("unit"), F.when(ambiguous, F.regexp_extract(tight, "([.,])", 1)).alias("separator"), F.when(ambiguous, F.concat(F.when(negative, "-").otherwise(""), tight)).alias("digits"))


def ambiguous_value(shape: Column, grouping: Column) -> Column:
    """The number of an ambiguous shape, once it is known whether its separator groups digits."""
    as_group = F.regexp_replace(shape["digits"], "[.,]", "").try_cast("double")
    as_point = F.replace(shape["digits"], F.lit(","), F.lit(".")).try_cast("double")
    return F.when(grouping, as_group).otherwise(as_point)


_DMY = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$"
_ISO = r"^\d{4}-\d{2}-\d{2}$"


def parse_date(c: Column) -> Column:
    """The calendar date of a cell in ISO form or day first, else null."""
    t = F.trim(c)
    day_first = F.concat_ws("-", F.regexp_extract(t, _DMY, 3), F.regexp_extract(t, _DMY, 2), F.regexp_extract(t, _DMY, 1))
    return F.when(t.rlike(_ISO), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike(_DMY), F.try_to_date(day_first, "yyyy-M-d"))


def settles_day_first(c: Column) -> Column:
    """Whether a date cell shows the order of its parts: ISO, or a day beyond 12."""
    t = F.trim(c)
    return t.rlike(_ISO) | (F.regexp_extract(t, _DMY, 1).try_cast("int") > 12)


def dates_in_text(c: Column) -> Column:
    """ISO forms of the dates a text writes in figures or with a month's name, in order of kind, once each."""
    iso = F.regexp_extract_all(c, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    figures = F.transform(F.regexp_extract_all(c, F.lit(r"\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b"), F.lit(0)), lambda d: F.date_format(parse_date(d), "yyyy-MM-dd"))
    month = lambda m: F.coalesce(*[F.when(m.isin(names.split()), F.lit(f"{n:02d}")) for n, names in MONTHS.items()])
    names = "|".join(" ".join(MONTHS.values()).split())
    folded = fold(c)
    pattern = rf"\b(\d{{1,2}})(?:er|\.)?\s+({names})\s+(\d{{4}})\b"
    written = F.transform(
        F.regexp_extract_all(folded, F.lit(pattern), F.lit(0)),
        lambda d: F.concat_ws("-", F.regexp_extract(d, pattern, 3), month(F.regexp_extract(d, pattern, 2)), F.lpad(F.regexp_extract(d, pattern, 1), 2, "0")),
    )
    return F.array_distinct(F.filter(F.concat(iso, figures, written), lambda d: d.isNotNull()))


def split_date_prefix(stem: Column) -> tuple[Column, Column]:
    """The date a file's stem opens with (YYYY-MM-DD, YYYYMMDD, YYYY-MM), and the rest."""
    pattern = r"^(\d{4})[-_.]?(\d{2})(?:[-_.]?(\d{2}))?(?=$|[^0-9])[-_. ]*"
    y, m, d = (F.regexp_extract(stem, pattern, i) for i in (1, 2, 3))
    good = (y != "") & m.between("01", "12") & ((d == "") | d.between("01", "31"))
    return F.when(good, F.when(d == "", F.concat_ws("-", y, m)).otherwise(F.concat_ws("-", y, m, d))), F.when(good, F.regexp_replace(stem, pattern, "")).otherwise(stem)


def numbers_in_text(c: Column, least_digits: int = 1) -> Column:
    """Numbers a text writes, grouping dropped and decimals after a point, of at least so many digits, once each."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\d.,])\d{1,3}(?:[  '’]\d{3})+(?:[.,]\d+)?(?![\p{L}\d])|(?<![\p{L}\d.,])\d+(?:[.,]\d+)?(?![\p{L}\d])"), F.lit(0))
    plain = F.transform(found, lambda n: F.replace(F.regexp_replace(n, r"[  '’]", ""), F.lit(","), F.lit(".")))
    return F.array_distinct(F.filter(plain, lambda n: F.length(F.regexp_replace(n, r"\D", "")) >= least_digits))


def unsupported_numbers(answer: Column, sources: Column, least_digits: int = 2) -> Column:
    """Numbers of an answer that no text of an array of sources holds."""
    known = F.flatten(F.transform(sources, lambda s: numbers_in_text(s, least_digits)))
    return F.array_except(numbers_in_text(answer, least_digits), known)


# Number words of English and French.
_EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_FR = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
_FR_TENS = "vingt trente quarante cinquante soixante".split()


def cardinal(n: int, language: str = "en") -> str:
    """A whole number in words, below 10 ** 12."""
    if n < 0:
        return ("minus " if language == "en" else "moins ") + cardinal(-n, language)
    if language == "en":
        if n < 20:
            return _EN[n]
        if n < 100:
            return _EN_TENS[n // 10 - 2] + (f"-{_EN[n % 10]}" if n % 10 else "")
        if n < 1000:
            return f"{_EN[n // 100]} hundred" + (f" {cardinal(n % 100)}" if n % 100 else "")
        for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")):
            if n >= size:
                return f"{cardinal(n // size)} {name}" + (f" {cardinal(n % size)}" if n % size else "")
    if n < 20:
        return _FR[n]
    if n < 70:
        joint = " et " if n % 10 == 1 else "-"
        return _FR_TENS[n // 10 - 2] + (joint + _FR[n % 10] if n % 10 else "")
    if n < 80:
        return "soixante et onze" if n == 71 else f"soixante-{_FR[n - 60]}"
    if n < 100:
        return "quatre-vingts" if n == 80 else f"quatre-vingt-{_FR[n - 80]}"
    if n < 1000:
        head = "cent" if n < 200 else f"{_FR[n // 100]} cent" + ("s" if n % 100 == 0 else "")
        return head + (f" {cardinal(n % 100, 'fr')}" if n % 100 else "")
    for size, name in ((10**9, "milliard"), (10**6, "million")):
        if n >= size:
            k = n // size
            return f"{cardinal(k, 'fr')} {name}{'s' if k > 1 else ''}" + (f" {cardinal(n % size, 'fr')}" if n % size else "")
    k = n // 1000
    head = "mille" if k == 1 else f"{cardinal(k, 'fr').removesuffix('s') if k % 100 in (80, 0) and k != 1 and cardinal(k, 'fr').endswith('s') else cardinal(k, 'fr')} mille"
    return head + (f" {cardinal(n % 1000, 'fr')}" if n % 1000 else "")

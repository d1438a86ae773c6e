"""Text as it is spoken: numbers, amounts, dates, times, phones and units in words, French and English."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.numbers import MONTHS, cardinal

# Units and currencies with their spoken forms, by language.
UNITS = {
    "fr": {"kg": "kilogrammes", "g": "grammes", "mg": "milligrammes", "km": "kilomètres", "m": "mètres", "cm": "centimètres", "mm": "millimètres", "l": "litres", "ml": "millilitres", "%": "pour cent", "€": "euros", "CHF": "francs", "h": "heures", "min": "minutes"},
    "en": {"kg": "kilograms", "g": "grams", "mg": "milligrams", "km": "kilometres", "m": "metres", "cm": "centimetres", "mm": "millimetres", "l": "litres", "ml": "millilitres", "%": "percent", "€": "euros", "CHF": "francs", "h": "hours", "min": "minutes"},
}
_POINT = {"fr": "virgule", "en": "point"}
_GAP = "[ \xa0 '’]"
_AMOUNT = rf"\d{{1,3}}(?:{_GAP}\d{{3}})+|\d+"
_SCAN = re.compile(
    rf"(?P<iso>\b\d{{4}}-\d{{2}}-\d{{2}}\b)|(?P<dmy>\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}\b)|(?P<time>\b\d{{1,2}}[:h]\d{{2}}\b)|(?P<phone>(?<![\d.])(?:\+\d{{2}}[ .]?\d{{1,2}}|0\d{{1,2}})(?:[ .]?\d{{2,3}}){{3,4}}(?!\d))"
    rf"|(?P<ordinal>\b\d{{1,3}}(?:er|re|e|ème|st|nd|rd|th)\b)|(?P<money>(?:CHF|€)\s?(?:{_AMOUNT})(?:[.,]\d{{2}})?)|(?P<number>(?<![\w.,])(?:{_AMOUNT})(?:[.,]\d+)?(?:\s?(?:%|€|CHF\b|kg\b|mg\b|g\b|km\b|cm\b|mm\b|ml\b|m\b|l\b|min\b|h\b))?(?![\w]))"
)
_ORDINALS = {"fr": {1: "premier", 2: "deuxième", 5: "cinquième", 9: "neuvième"}, "en": {1: "first", 2: "second", 3: "third", 5: "fifth", 8: "eighth", 9: "ninth", 12: "twelfth"}}


def ordinal(n: int, language: str = "fr") -> str:
    if n in _ORDINALS[language]:
        return _ORDINALS[language][n]
    word = cardinal(n, language)
    if language == "fr":
        for end, out in (("cinq", "cinquième"), ("neuf", "neuvième"), ("e", "ième"), ("s", "ième")):
            if word.endswith(end) and not (end == "s" and word.endswith("trois")):
                return word[: len(word) - len(end)] + out
        return word + "ième"
    head, dash, last = word.rpartition("-") if "-" in word else word.rpartition(" ")
    units = {cardinal(k): v for k, v in _ORDINALS["en"].items()}
    tail = units.get(last, last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return head + dash + tail


def digits(text: str, language: str = "fr") -> str:
    """Digits of an identifier one by one."""
    return " ".join(cardinal(int(c), language) for c in text if c.isdigit())


def number(text: str, language: str = "fr") -> str:
    """A number as people write it, its decimals read as a number too, zeros first one by one."""
    whole, _, decimals = re.sub(_GAP, "", text).replace(",", ".").partition(".")
    said = cardinal(int(whole), language)
    if not decimals:
        return said
    zeros = len(decimals) - len(decimals.lstrip("0"))
    rest = decimals.lstrip("0")
    return " ".join([said, _POINT[language], *[cardinal(0, language)] * (zeros if rest else 1), *([cardinal(int(rest), language)] if rest else [])])


def _month(n: int, language: str) -> str:
    fr, en, *_ = MONTHS[n].split()
    return {"fr": {"fevrier": "février", "aout": "août", "decembre": "décembre"}.get(fr, fr), "en": en.capitalize()}[language]


def date(year: int, month: int, day: int, language: str = "fr") -> str:
    if not 1 <= month <= 12:
        return digits(f"{day}{month}{year}", language)
    first = ("premier" if day == 1 else cardinal(day, "fr")) if language == "fr" else ordinal(day, "en")
    return f"{first} {_month(month, language)} {cardinal(year, language)}" if language == "fr" else f"{_month(month, language)} {first}, {cardinal(year, language)}"


@lru_cache(maxsize=50_000)
def _said(kind: str, text: str, language: str) -> str:
    if kind in ("iso", "dmy"):
        a, b, c = map(int, re.findall(r"\d+", text))
        return date(a, b, c, language) if kind == "iso" else date(c, b, a, language)
    if kind == "time":
        h, m = map(int, re.findall(r"\d+", text))
        hours = f"{cardinal(h, language)} {'heures' if h != 1 else 'heure'}" if language == "fr" else cardinal(h, language)
        return hours if not m else f"{hours} {cardinal(m, language)}"
    if kind == "phone":
        return digits(text, language)
    if kind == "ordinal":
        return ordinal(int(re.match(r"\d+", text)[0]), language)  # type: ignore[index]
    if kind == "money":
        unit, amount = re.match(r"(CHF|€)\s?(.*)", text).groups()  # type: ignore[union-attr]
        return f"{number(amount, language)} {UNITS[language][unit]}"
    amount, unit = re.match(rf"((?:{_AMOUNT})(?:[.,]\d+)?)\s?(.*)", text).groups()  # type: ignore[union-attr]
    return f"{number(amount, language)} {UNITS[language][unit]}" if unit else number(amount, language)


def spoken(text: str, language: str = "fr") -> str:
    """A text with everything written in figures said in words; all else stays."""
    return _SCAN.sub(lambda m: _said(m.lastgroup or "number", m.group(), language), text)


def spoken_form(c: Column, language: str = "fr") -> Column:
    """spoken of a column, null for null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else spoken(t, language))

    return run(c)


def digits_one_by_one(c: Column) -> Column:
    """Digits of a column in French words, one by one, in the JVM."""
    words = F.array(*[F.lit(cardinal(i, "fr")) for i in range(10)])
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\d"), F.lit(0)), lambda d: F.get(words, d.cast("int"))), " ")

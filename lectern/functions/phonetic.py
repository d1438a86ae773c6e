"""Phonetic keys of words: a rule encoder for French and one for English, as vectorised functions.

A key keeps the sounds that tell names apart and drops what spellings vary in: silent endings, doubled letters,
interchangeable consonants. Keys are versioned, since stored keys must be rebuilt when the rules change.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1

# Spellings and the sounds they stand for, tried in order. Vowels: a e i o u, nasal ones A I O.
_FRENCH = [
    (r"[^a-z]", ""), (r"^h", ""), (r"ph", "f"), (r"sch|sh|ch", "S"), (r"qu|q", "k"), (r"gn", "N"), (r"gu(?=[eiy])", "g"), (r"ge(?=[ao])", "j"), (r"g(?=[eiy])", "j"),
    (r"c(?=[eiy])", "s"), (r"c|k", "k"), (r"th", "t"), (r"x$|s$|t$|d$|p$|z$", ""), (r"x", "ks"), (r"(?<=[aeiouy])s(?=[aeiouy])", "z"), (r"eaux|eau|aux|au", "o"), (r"ain|ein|in|im(?=[bp])|yn", "I"),
    (r"an|am(?=[bp])|en|em(?=[bp])", "A"), (r"on|om(?=[bp])", "O"), (r"ai|ei|ay|ey", "e"), (r"ou", "u"), (r"oi|oy", "wa"), (r"oe|eu", "e"), (r"y", "i"), (r"w", "v"), (r"h", ""), (r"e$|es$", ""), (r"(.)\1+", r"\1"),
]
_ENGLISH = [
    (r"[^a-z]", ""), (r"^kn|^gn|^pn", "n"), (r"^wr", "r"), (r"^ps", "s"), (r"^x", "s"), (r"ph", "f"), (r"tch|ch", "C"), (r"sh", "S"), (r"th", "T"), (r"ght", "t"), (r"gh", ""), (r"ck|q|c(?![eiy])|k", "k"), (r"c", "s"),
    (r"dge|dg|j|g(?=[eiy])", "J"), (r"x", "ks"), (r"wh", "w"), (r"mb$", "m"), (r"z", "s"), (r"v", "f"), (r"(?<=.)[aeiouyhw]", ""), (r"(.)\1+", r"\1"),
]
_RULES = {"fr": [(re.compile(a), b) for a, b in _FRENCH], "en": [(re.compile(a), b) for a, b in _ENGLISH]}


def key(word: str, language: str = "fr") -> str:
    """Key of a folded word; an empty word has an empty key."""
    for pattern, sound in _RULES[language]:
        word = pattern.sub(sound, word)
    return word


def phonetic_key(c: Column, language: str = "fr") -> Column:
    """key of a column of folded words, null for null."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        return pd.Series([None if w is None else memo.setdefault(w, key(w, language)) for w in words], dtype=object)

    return run(c)

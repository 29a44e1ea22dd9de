"""The Porter stemmer with the extensions of its widely used Python form, applied to distinct terms only."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shipping import ship

#: Irregular forms, as "stem: forms".
IRREGULAR = {
    form: line.split(":")[0]
    for line in ("sky: sky skies", "die: dying", "lie: lying", "tie: tying", "news: news", "inning: innings inning", "outing: outings outing",
                 "canning: cannings canning", "howe: howe", "proceed: proceed", "exceed: exceed", "succeed: succeed")
    for form in line.split(": ")[1].split()
}

#: Suffix and replacement, in order of trial.
STEP_2 = ("ational ate", "tional tion", "enci ence", "anci ance", "izer ize", "bli ble", "alli al", "entli ent", "eli e", "ousli ous", "ization ize", "ation ate",
          "ator ate", "alism al", "iveness ive", "fulness ful", "ousness ous", "aliti al", "iviti ive", "biliti ble", "fulli ful", "logi log")
STEP_3 = ("icate ic", "ative ", "alize al", "iciti ic", "ical ic", "ful ", "ness ")
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """A consonant, a vowel and a consonant other than w, x, y at the end; or a word of a vowel and a consonant."""
    shape = _shape(word)
    return (len(word) >= 3 and shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        stem = word[: -len(end)]
        if word.endswith(end) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _replaced(word: str, rules: tuple[str, ...]) -> str:
    """The first rule whose suffix fits decides, whether or not its stem is long enough."""
    for rule in rules:
        suffix, new = rule.split(" ")
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            kept = word[:-3] if suffix == "logi" else stem
            return stem + new if _measure(kept) > 0 else word
    return word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    return _replaced(word, STEP_2)


def _stripped(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem if _measure(stem) > 1 else word
    return word


def _tidied(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(50_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return _tidied(_stripped(_replaced(_derived(word), STEP_3)))


def _stem_column(term: Column) -> Column:
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return stems(term)


def stem_terms(postings: DataFrame, term: str = "term") -> DataFrame:
    """``postings`` with ``stem``: only distinct terms go through Python, and join back."""
    ship(postings.sparkSession)
    vocabulary = postings.select(term).distinct().withColumn("stem", _stem_column(F.col(term)))
    return postings.join(vocabulary, term)

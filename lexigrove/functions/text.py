"""Tokens, conditions and text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop-words of the retrieval contract, in alphabetical order.
STOP_WORDS = (
    "a about above after against an and are as at be been before being below between but by can could did do does doing down "
    "during else for from had has have having if in into is it its may might must no not of on or our shall should so such than "
    "that the their then these this those through to up was we were which who whom will with would"
).split()

#: Fixed values of the retrieval contract: which characters connect the parts of a word, and which make up words and numbers.
HYPHENS = "\\-‐‑–"
_C = f"[{HYPHENS}]"
# single characters first: the JVM looks them up in a table before it asks for properties
_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_A = rf"[{_PLAIN}\p{{L}}\p{{N}}]"
_X = r"[\p{L}\p{Nl}\p{No}]"
#: White space as Unicode has it; the JVM's \s is ASCII only.
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"
#: A hyphen between two digits; the hyphen is tried first, what is before it only then.
RANGE = rf"{_C}(?<=\p{{Nd}}{_C})(?=\p{{Nd}})"
# initials with points, then numbers (which a letter or an apostrophe may not follow), then words and their connected parts
TOKEN = rf"(?:[A-Za-z]\.){{2,}}|\p{{Nd}}+(?:\.\p{{Nd}}+)*%?(?![\p{{L}}\p{{N}}_’']|{_C}{_X})|{_A}+(?:['’{HYPHENS}]{_A}+)*"
MARK = r"[^\s\p{Z}\x1C-\x1F\x85]"
#: Characters that fold to something else than their lower case, by Unicode's own tables (sharp s and final sigma are done by the way).
FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1F000)) if c.casefold() != c.lower() and c not in "ßς"}


def _class_of(chars: str, gap: int = 40) -> str:
    """A regex class of ranges that hold ``chars`` (and what lies in small gaps between them); common letters are told apart by its first two parts."""
    codes = sorted(map(ord, chars))
    ranges = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c - ranges[-1][1] > gap or ranges[-1][1] < 0x130:
            ranges.append([c, c])
        ranges[-1][1] = c
    return "[\\u00b5\\u0130-\\uffff&&[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]]"


_SPECIAL = _class_of("".join(FOLDS))
#: Letters whose folded form has another number of characters, or is ASCII where they are not.
_AWKWARD = _class_of("\u0130\u212a" + "".join(FOLDS))

CONDITIONS = ("A", "B", "C", "D")


def casefold(text: Column) -> Column:
    """Case folding: lower case, ß as ss, one form of sigma, and where a text has any, the characters with folds of their own."""
    table = F.str_to_map(F.lit("|".join(f"{c}~{fold}" for c, fold in FOLDS.items())), F.lit("\\|"), F.lit("~"))
    lower = F.lower(text)
    each = F.array_join(F.transform(F.split(lower, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.replace(F.translate(F.when(text.rlike(_SPECIAL), each).otherwise(lower), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def _folded_matches(text: Column, cut: str, between: str, pattern: str) -> Column:
    """The matches of ``pattern``, folded. Folding the text first gives the same, but for the awkward letters."""
    found = lambda t: F.regexp_extract_all(F.regexp_replace(t, F.lit(cut), F.lit(between)), F.lit(pattern), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(_AWKWARD), F.transform(found(text), casefold)).otherwise(found(casefold(text)))


def tokens(text: Column) -> Column:
    """The words of a text, folded: initials with points, numbers, and words joined by hyphens or apostrophes."""
    return _folded_matches(text, RANGE, " ", TOKEN)


def tokens_and_marks(text: Column) -> Column:
    """Condition A: words, and each other visible character by itself."""
    return _folded_matches(text, f"({_C})(?<=\\p{{Nd}}{_C})(?=\\p{{Nd}})", " $1 ", f"{TOKEN}|{MARK}")


def has_word_character(term: Column) -> Column:
    return term.rlike(_A)


def is_stop_word(term: Column) -> Column:
    return term.isin(STOP_WORDS)


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda t: ~is_stop_word(t))


def condition_tokens(text: Column, condition: str, stem=None) -> Column:
    """Words under condition A (all), B (with a letter or digit), C (no stop-words); D is C, stemmed by ``stem``."""
    words = tokens_and_marks(text)
    if condition >= "B":
        words = F.filter(words, has_word_character)
    if condition >= "C":
        words = without_stop_words(words)
    if condition >= "D":
        if stem is None:
            raise ValueError("condition D needs a stemmer; see functions.stem.stem_terms for the join over distinct terms")
        words = stem(words)
    return words


def one_hyphen(term: Column) -> Column:
    """The three hyphen variants as an ASCII hyphen."""
    return F.translate(term, "‐‑–", "---")


def weighting_tokens(text: Column, stop_words: bool = True) -> Column:
    words = F.transform(tokens(text), one_hyphen)
    return without_stop_words(words) if stop_words else words


def news_tokens(text: Column) -> Column:
    """Words with a letter, without stop-words."""
    return F.filter(without_stop_words(tokens(text)), lambda t: t.rlike(_X))


def news_tokens_or(text: Column, mark: str) -> Column:
    """``news_tokens`` and, where they stand, the marks: a character that no word has."""
    return F.filter(_folded_matches(text, RANGE, " ", f"{TOKEN}|{mark}"), lambda t: (t == mark) | (~is_stop_word(t) & t.rlike(_X)))


def index_text(text: Column) -> Column:
    """The text without the label of a keyword line."""
    return F.regexp_replace(text, F.lit(r"(?i)(?<![\p{L}\p{N}_\-])Keywords?\s*:"), F.lit(" "))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(f"{SPACE}+"), F.lit(" ")))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(MARK), F.lit(False))


def char_count(text: Column) -> Column:
    return F.length(collapse(text))


def char_count_no_space(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(SPACE), F.lit("")))


def topic_key(name: Column) -> Column:
    return casefold(collapse(name))


def variant_key(term: Column) -> Column:
    """Terms that differ in connectors only share a key; null where connectors must not be ignored."""
    folded = casefold(term)
    bare = F.regexp_replace(folded, F.lit(_C), F.lit(""))
    good = (F.length(folded) >= 3) & folded.rlike(r"\p{L}") & folded.rlike(rf"^(?:{_A}|{_C})+$") & (F.length(bare) >= 3)
    return F.when(good, bare)


def content_term(term: Column) -> Column:
    """Two characters or more, one of them a letter."""
    return (F.length(term) >= 2) & term.rlike(r"\p{L}")


def spelling_candidate(term: Column) -> Column:
    return F.length(term).between(2, 32) & term.rlike(r"\p{L}") & ~is_stop_word(term)


def csv_safe(text: Column) -> Column:
    """A text that a spreadsheet would read as a formula, with an apostrophe before it."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def stable_hash(text: Column) -> Column:
    """The first eight bytes of SHA-256 as 16 hexadecimal digits; their order is that of the bytes."""
    return F.substring(F.sha2(text, 256), 1, 16)


def sample_key(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def snippet(text: Column, anchor: Column, before: int = 180, size: int = 760) -> Column:
    """``size`` characters around the 0-based ``anchor``, with an ellipsis where text is left out."""
    text = collapse(text)
    start = F.greatest(anchor - before, F.lit(0))
    cut = F.substring(text, start + 1, F.lit(size))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.trim(cut), F.when(start + size < F.length(text), F.lit("…")).otherwise(F.lit("")))


def escape_html(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text

"""Sentences as an array, by two regular expressions: paragraphs first, then ends of sentences within them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let
from .text import SPACE, collapse, news_tokens, news_tokens_or, tokens

#: Abbreviations that end no sentence.
ABBREVIATIONS = "dr mr mrs ms prof sr jr vs etc al fig figs eq eqs approx no nos vol vols pp p cf et inc ltd co st".split()
INITIALISMS = "e.g i.e a.m p.m".split()
CLOSERS = r"[\"'”’)\]}]*"

# conditions on what stands before a point look back over it, so that they are tried at points only
_ABBREVIATED = rf"(?<!(?<![A-Za-z])(?i:{'|'.join(ABBREVIATIONS)})\.)(?<!(?i:{'|'.join(x.replace('.', chr(92) + '.') for x in INITIALISMS)})\.)"
# a point after one capital letter is an initial's if a capital follows
_POINT = rf"\.{_ABBREVIATED}(?:(?<!(?<![A-Za-z])[A-Z]\.)|(?!{CLOSERS}{SPACE}*\p{{Lu}}))"
END = rf"((?:{_POINT}|[!?。！？]){CLOSERS}){SPACE}+"
BREAK = "\u0001"


def sentences(text: Column) -> Column:
    """The sentences of a text: array of trimmed, non-empty strings."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), r"\r?\n+")
    marked = F.transform(paragraphs, lambda p: F.regexp_replace(p, F.lit(END), F.lit(f"$1{BREAK}")))
    pieces = F.flatten(F.transform(marked, lambda p: F.split(p, BREAK)))
    trimmed = F.transform(pieces, lambda s: F.regexp_replace(s, F.lit(f"^{SPACE}+|{SPACE}+$"), F.lit("")))
    return F.filter(trimmed, lambda s: s != "")


def news_sentences(text: Column) -> Column:
    """Words of each sentence with two words or more; line breaks do not end sentences."""
    return F.filter(F.transform(sentences(collapse(text)), news_tokens), lambda words: F.size(words) >= 2)


def news_words(text: Column) -> Column:
    """Words of a text as ``news_tokens`` has them, with ``BREAK`` between sentences as ``news_sentences`` parts them: both from one pass.

    Words hold no white space and sentences end before some, so that no word is lost or cut by a mark.
    """
    return news_tokens_or(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(END), F.lit(f"$1{BREAK}")), BREAK)


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def words_per_sentence(text: Column) -> Column:
    return let(sentence_count(text), lambda count: F.when(count > 0, F.round(F.size(tokens(text)) / count, 2)).otherwise(F.lit(0.0)))


def condition_sentences(text: Column, condition: str = "B") -> Column:
    """Words of each sentence under a condition (A to C), of sentences with two words or more."""
    from .text import condition_tokens

    return F.filter(F.transform(sentences(text), lambda s: condition_tokens(s, condition)), lambda words: F.size(words) >= 2)

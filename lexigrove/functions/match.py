"""Which words of a text a query matches: spans, counts, highlights and snippets around the first match."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import match_spans, replace_spans
from .stem import stem
from .text import HYPHENS, MARK, RANGE, TOKEN, casefold, collapse, escape_html, snippet, variant_key


def token_spans(text: Column) -> Column:
    """array<struct<start, end, term>> of words in code points; ranges are cut without moving offsets."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(RANGE), F.lit(" "))
    return F.transform(match_spans(cut, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), casefold(s["match"]).alias("term")))


@dataclass(frozen=True)
class Wanted:
    """What a query's words match: themselves, words with their stems, words with their variant keys. Stop-words stay."""

    words: tuple[str, ...]
    stems: tuple[str, ...] = field(init=False)
    keys: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "stems", tuple(sorted({stem(w) for w in self.words})))
        bare = {w: "".join(c for c in w if c not in HYPHENS.replace("\\", "")) for w in self.words}
        keys = {k for w, k in bare.items() if len(k) >= 3 and k.isalnum() and any(c.isalpha() for c in k)}
        object.__setattr__(self, "keys", tuple(sorted(keys)))


def matches(term: Column, wanted: Wanted, stemmed: Column | None = None) -> Column:
    """Whether a word matches; without ``stemmed`` (a word's stem) a word matches by itself or its variant key only."""
    hit = term.isin(list(wanted.words))
    if wanted.keys:
        hit = hit | F.coalesce(variant_key(term).isin(list(wanted.keys)), F.lit(False))
    return hit | stemmed.isin(list(wanted.stems)) if stemmed is not None else hit


def match_count(text: Column, wanted: Wanted) -> Column:
    return F.size(F.filter(token_spans(text), lambda s: matches(s["term"], wanted)))


def highlight(text: Column, wanted: Wanted, before: str = "<mark>", after: str = "</mark>", first: Column | None = None) -> Column:
    """The text as HTML with matching words marked; with ``first`` marks are numbered, as ids, from the one after it."""
    hits = F.filter(token_spans(text), lambda s: matches(s["term"], wanted))
    return _marked(text, hits, before, after, first)


def highlight_term(text: Column, term: str, condition: str = "A", forms: tuple[str, ...] = (), before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text as HTML with the words marked that are ``term`` under a condition; under D, those that are one of its ``forms``."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(RANGE), F.lit(" "))
    wanted = list(forms) if condition == "D" else [term]
    spans = F.filter(match_spans(cut if condition >= "B" else F.coalesce(text, F.lit("")), TOKEN if condition >= "B" else f"{TOKEN}|{MARK}"), lambda s: casefold(s["match"]).isin(wanted))
    return _marked(text, spans, before, after)


def _marked(text: Column, spans: Column, before: str, after: str, first: Column | None = None) -> Column:
    def mark(word: Column, nth: Column) -> Column:
        head = F.lit(before) if first is None else F.concat(F.lit(before.rstrip(">") + ' id="match-'), (first + nth + 1).cast("string"), F.lit('">'))
        return F.concat(head, escape_html(word), F.lit(after))

    return replace_spans(F.coalesce(text, F.lit("")), spans, mark, escape_html)


def first_match(text: Column, wanted: Wanted) -> Column:
    """Where the first matching word starts, 0-based; 0 if none does."""
    hits = F.filter(token_spans(text), lambda s: matches(s["term"], wanted))
    return F.coalesce(F.get(hits, F.lit(0))["start"], F.lit(0))


def query_snippet(text: Column, wanted: Wanted, before: int = 180, size: int = 760) -> Column:
    """The part of a text around its first match; weighting pages use (80, 360)."""
    flat = collapse(text)
    return snippet(flat, first_match(flat, wanted), before, size)


def lead(text: Column, size: int = 260) -> Column:
    """The beginning of a text, for lists (220) and results (260)."""
    flat = collapse(text)
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("…"))).otherwise(flat)


def paragraphs(text: Column) -> Column:
    """A body's paragraphs, parted by indented lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s{2,}|\n\s*\n"), collapse), lambda p: p != "")

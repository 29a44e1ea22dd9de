"""Spans of regex matches in a text, with JVM expressions only; their cost is in proportion to the text and its matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that one fold carries along, and code points that one piece of a text holds.
BLOCK, PIECE = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (array<int>) what those before it amount to by ``merge``, 0 at first.

    A fold that appends copies its list at each step, so blocks are folded on their own, and then the blocks' totals.
    """

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / BLOCK).cast("int")), lambda b: fold(F.slice(xs, b * BLOCK + 1, BLOCK)))
        return let(blocks, lambda parts: F.flatten(F.zip_with(parts, fold(F.transform(parts, lambda p: p["at"]))["out"], lambda p, at: F.transform(p["out"], lambda x: merge(at, x)))))

    return let(values, of)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, match string>> of leftmost non-overlapping matches, in code points.

    The text between matches comes from ``split``; a match starts where the gaps and matches before it end.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), _placed(gaps, found)).otherwise(none)


def _placed(gaps: Column, found: Column) -> Column:
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))  # one more gap than matches

    def place(x: Column) -> Column:
        sums = before(F.transform(x, lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0))), lambda a, b: a + b)
        placed = F.zip_with(x, sums, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["match"].alias("match")))
        return F.filter(placed, lambda s: s["match"].isNotNull())

    return let(parts, place)


def replace_matches(text: Column, pattern: str, replacement) -> Column:
    """The text with each leftmost non-overlapping match m replaced by ``replacement(m)``."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    new = F.concat(F.transform(found, replacement), F.array(F.lit("")))  # one more gap than matches
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def replace_spans(text: Column, spans: Column, mark: str | Callable[[Column, Column], Column], between: Callable[[Column], Column] = lambda x: x) -> Column:
    """The text with its ``spans`` (struct<start, end, ...>, sorted by start) replaced by ``mark``; overlapping ones become one mark.

    A mark can be made of what a span holds and its number; ``between`` is applied to what stands between spans. ``substring``
    counts from a text's beginning, so the text is cut into pieces first and a stretch is taken from those it lies in.
    """
    marked = mark if callable(mark) else lambda _, __: F.lit(mark)

    def rebuilt(x: Column) -> Column:
        part = lambda a, b: F.substring(F.array_join(F.slice(x["pieces"], F.floor(a / PIECE).cast("int") + 1, F.floor((b - a) / PIECE).cast("int") + 2), ""), a % PIECE + 1, b - a)
        done = before(F.transform(x["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        placed = F.zip_with(x["spans"], done, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))
        heads = F.transform(placed, lambda s, i: F.when(s["start"] >= s["at"], F.concat(between(part(s["at"], s["start"])), marked(part(s["start"], s["end"]), i))).otherwise(F.lit("")))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(heads, ""), between(part(end, F.greatest(x["size"], end))))

    held = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), spans.alias("spans"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, let(held, rebuilt)).otherwise(between(text))

"""Secret scans with JVM expressions only: named assignments, access keys, hexadecimal runs, and strings of high entropy.

The entropy scan takes candidates, runs of ``MINIMUM`` or more characters of base64 (also the URL-safe kind) with their
padding, so an assignment's name and its sign are no part of them. A candidate's class, hexadecimal or base64, is told from its
characters; a window of ``WINDOW`` characters slides over it, and counts per character are kept from step to step: a character
that enters and one that leaves change the sum of c log c by two terms each. A candidate with a window whose Shannon entropy
reaches its class's threshold is reported as a whole. One that has none is parted at its separators, and each stretch of letters
and digits is rated as a candidate of its own, so that a hexadecimal secret in a path is held against its own threshold.

Allow-lists: plain numbers, UUIDs, and names made of words and short numbers are no candidates; windows do not reach into a
``PLACEHOLDER``, but what stands beside one is rated. A span that a span found by name covers is not repeated. Sums are whole
numbers of micro-bits, so that every engine agrees on them.

Defined results: a null text is an empty one; a text without secrets has empty span lists; texts of any length and any number of
matches take time in proportion; each row gives a row, repeated rows too; an empty table gives no rows; all columns of the input
are kept and ``base`` and ``entropy`` are added, or replaced where the input has columns of these names and no others are given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import before, let, match_spans, replace_spans


def either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = "(" + NAMES + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
MINIMUM = 20
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
STRETCH = "[A-Za-z0-9]{20,}"
#: Class: its characters, and the entropy in bits that a window must reach.
CLASSES = {"entropy_hex": ("^[0-9a-fA-F]+$", 3.0), "entropy_base64": ("^[A-Za-z0-9+/_=-]+$", 3.8)}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What a candidate must hold: all else is a name made of words and numbers of up to four digits, as are runs of one character.
MIXED = "[0-9][A-Za-z]|[0-9]{5}"
#: Candidates that are not secrets: plain numbers and UUIDs.
ALLOWED = ("^[0-9]+$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
#: Parts of a candidate that no window reaches into.
PLACEHOLDER = "|".join(map(either_case, ("example", "sample", "placeholder", "changeme", "dummy", "redacted", "xxxxxx", "012345", "abcdef")))
#: c log2 c in micro-bits, for counts up to the window and one more.
COUNT_BITS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]

SPAN = "struct<start:int,kind:int,end:int>"


def most_sum(bits: float, window: int = WINDOW) -> int:
    """The largest sum of c log2 c, in micro-bits, of a window whose entropy is ``bits`` or more."""
    return math.floor(1e6 * window * (math.log2(window) - bits))


def least_sum(text: Column) -> Column:
    """The smallest sum of c log2 c, in micro-bits, of any window of ``text``, which has ``WINDOW`` characters of ``ALPHABET`` or more.

    One pass; the counts are a string of one character for each of ``ALPHABET``, "0" and up, of which a step replaces two.
    """
    table = F.array(*[F.lit(x).cast("long") for x in COUNT_BITS])
    place = lambda c: F.position(c, F.lit(ALPHABET))
    count = lambda n, c: F.ascii(F.substring(n, place(c), F.lit(1))) - 48
    bits = lambda c: F.element_at(table, c + 1)
    never = F.lit(1 << 60)

    def scan(chars: Column) -> Column:
        start = F.struct(F.repeat(F.lit("0"), len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), never.alias("least"))

        def leave(a: Column) -> Column:
            old = F.get(chars, a["i"] - WINDOW)
            n = count(a["n"], old)
            gone = F.struct(F.overlay(a["n"], F.char(n + 47), place(old)).alias("n"), (a["sum"] + bits(n - 1) - bits(n)).alias("sum"))
            return F.when(a["i"] >= WINDOW, gone).otherwise(F.struct(a["n"].alias("n"), a["sum"].alias("sum")))

        def step(a: Column, c: Column) -> Column:
            def enter(b: Column) -> Column:
                n = count(b["n"], c)
                return F.struct(F.overlay(b["n"], F.char(n + 49), place(c)).alias("n"), (b["sum"] + bits(n + 1) - bits(n)).alias("sum"))

            def noted(d: Column) -> Column:
                least = F.when(a["i"] + 1 >= WINDOW, F.least(a["least"], d["sum"])).otherwise(a["least"])
                return F.struct(d["n"].alias("n"), d["sum"].alias("sum"), (a["i"] + 1).alias("i"), least.alias("least"))

            return let(let(leave(a), enter), noted)

        return F.aggregate(chars, start, step, lambda a: a["least"])

    return let(F.split(text, ""), scan)


def is_hex(text: Column) -> Column:
    return text.rlike(CLASSES["entropy_hex"][0])


def is_secret(text: Column) -> Column:
    """Whether a candidate is outside the allow-lists and has a window of its class's entropy beside any placeholder."""
    limit = F.when(is_hex(text), F.lit(most_sum(CLASSES["entropy_hex"][1]))).otherwise(F.lit(most_sum(CLASSES["entropy_base64"][1])))
    known = ~text.rlike(MIXED)
    for pattern in ALLOWED:
        known = known | text.rlike(pattern)
    parts = F.filter(F.split(text, PLACEHOLDER), lambda p: F.length(p) >= WINDOW)
    return ~known & F.exists(parts, lambda p: least_sum(p) <= limit)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The spans found by name or form, by start, then kind."""
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12)
    return F.array_sort(F.concat(_kind(assign, "assign"), _kind(match_spans(text, ACCESS), "access"), _kind(match_spans(text, HEX), "hex")))


def entropy_spans(text: Column, base: Column) -> Column:
    """The spans of candidate strings with a window of high entropy, without those that a span of ``base`` covers."""
    kind = lambda m: F.when(is_hex(m), F.lit(KINDS.index("entropy_hex"))).otherwise(F.lit(KINDS.index("entropy_base64")))
    span = lambda s, at: F.struct((s["start"] + at).alias("start"), kind(s["match"]).alias("kind"), (s["end"] + at).alias("end"))
    uuid = ALLOWED[1]

    def of_run(run: Column) -> Column:
        stretches = F.filter(match_spans(run["match"], STRETCH), lambda s: is_secret(s["match"]))
        inner = F.transform(stretches, lambda s: span(s, run["start"]))
        return F.when(is_secret(run["match"]), F.array(span(run, F.lit(0)))).otherwise(inner)

    runs = F.filter(match_spans(text, CANDIDATE), lambda s: s["match"].rlike(MIXED) & ~s["match"].rlike(uuid))
    spans = F.flatten(F.transform(runs, of_run))
    return F.when(text.rlike(CANDIDATE), uncovered(spans, base)).otherwise(F.array().cast(f"array<{SPAN}>"))


def uncovered(spans: Column, base: Column) -> Column:
    """``spans`` that no span of ``base`` covers: in order of start, none of base's before it ends as late."""
    mark = lambda xs, is_base: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(not is_base).alias("own"), s["end"].alias("end"), s["kind"].alias("kind")))

    def kept(x: Column) -> Column:
        reach = before(F.transform(x, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), lambda a, b: F.greatest(a, b))
        held = F.zip_with(x, reach, lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (s["own"] & (r < s["end"])).alias("keep")))
        return F.transform(F.filter(held, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return let(F.array_sort(F.concat(mark(base, True), mark(spans, False))), kept)


def scan_secrets(docs: DataFrame, base: str = "base", entropy: str = "entropy") -> DataFrame:
    """``docs(text, ...)`` with ``base`` and ``entropy`` (or other names), each array<struct<start, kind (its place in KINDS), end>>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(entropy, entropy_spans(text, F.col(base)))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans, sorted by start, replaced; overlapping ones become one mark."""
    return replace_spans(text, spans, mark)

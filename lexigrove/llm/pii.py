"""PII pseudonyms with JVM expressions only: a keyed Feistel network permutes each value within its own format.

``feistel`` splits a value into two halves; each round adds to every letter and digit of one half a key stream, the HMAC-SHA256
of round, tweak and the other half, within the character's class. So lengths, cases and separators stay, equal values get equal
pseudonyms in every document, and the key's owner can invert it. What a format fixes (a domain, a country, a layout) is the
tweak, so short values of different formats do not move alike. The keys of the HMAC are derived from the key that is given and
reach the executors as a one-row table, so no plan, explanation or event log shows them.

Values are validated before they count: cards by issuer, layout and Luhn, IBANs by country, length and modulo 97, addresses by
octet, dates by the calendar, social security numbers by their reserved ranges, phones by their number of digits; each pseudonym
is valid again. A number or date that is not valid is left as it is; of four groups of four digits and a fifth group the first
four count alone if they are valid. A date is moved within its block of 65,536 days (about 179 years); dd/mm/yyyy is
read before mm/dd/yyyy.

Defined results: a null text stays null; a text without PII is unchanged; very long texts are treated as a whole; all columns of
the input are kept and ``pseudonymized`` and ``found`` (kind of each value, in order) are added, or replaced where the input has
such columns; each row gives a row, repeated rows too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from .shared import free_name

ROUNDS = 6

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    by_length = defaultdict(list)
    for country, n in IBAN_LENGTHS.items():
        by_length[n].append(country)
    return r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())) + r")(?![A-Za-z0-9])"


EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}"
IBAN = _iban()
#: International numbers, North American ones without a country code, and national ones that begin with 0.
PHONE = (
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ ./-]?[0-9]){5,12}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
    r"|(?<![0-9A-Za-z.,/-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9A-Za-z]|[ .-][0-9])"
    r"|(?<![0-9A-Za-z.,/-])0[1-9][0-9]{1,4}[ /-][0-9]{3,4} ?[0-9]{3,5}(?![0-9A-Za-z]|[.,/-][0-9])"
)
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
#: 13 to 19 digits in one piece, groups of four, or 4-6-4 and 4-6-5.
CARD = (
    r"(?<![0-9A-Za-z])(?:[2-6][0-9]{12,18}(?![0-9A-Za-z])"
    r"|[2-6][0-9]{3}(?:(?: [0-9]{4}){3}(?: [0-9]{1,3})?|(?:-[0-9]{4}){3}(?:-[0-9]{1,3})?|(?: [0-9]{6} [0-9]{4,5}|-[0-9]{6}-[0-9]{4,5}))(?![0-9A-Za-z]))"
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = (
    r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9]{2})|(?![0-9A-Za-z-]))"
    r"|(?<![0-9A-Za-z/.])(?:[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2})(?![0-9A-Za-z]|[/.][0-9])"
    r"|(?<![0-9A-Za-z/.-])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|[/.-][0-9])"
    rf"|(?<![0-9A-Za-z])[0-9]{{1,2}} (?:{MONTHS}) [0-9]{{4}}(?![0-9A-Za-z])"
    rf"|(?<![A-Za-z])(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}(?![0-9A-Za-z])"
)
ANY = "|".join((EMAIL, IBAN, PHONE, IPV4, SSN, DATE, CARD))
#: Every match of ``ANY`` holds one of these.
GATE = r"[0-9]{2}|@|[0-9]\.[0-9]"

#: Java patterns of dates: the form that a date has, as a regex, and its pattern, in order of preference.
DATE_FORMS = (
    ("[0-9]{4}-.*", "yyyy-MM-dd"), ("[0-9]{4}/.*", "yyyy/MM/dd"), ("[0-9]{4}[.].*", "yyyy.MM.dd"),
    ("[0-9]{2}/[0-9]{2}/.*", "dd/MM/yyyy"), ("[0-9]{2}/[0-9]{2}/.*", "MM/dd/yyyy"), ("[0-9]+/.*", "d/M/yyyy"), ("[0-9]+/.*", "M/d/yyyy"),
    ("[0-9]{2}[.][0-9]{2}[.].*", "dd.MM.yyyy"), ("[0-9]+[.].*", "d.M.yyyy"), ("[0-9]{2}-.*", "dd-MM-yyyy"), ("[0-9]{2}-.*", "MM-dd-yyyy"),
    ("[0-9]+ .*", "d MMMM yyyy"), ("[A-Z].*", "MMMM d, yyyy"),
)
#: Days are counted from this one, in blocks of two bytes; blocks from this to that (the years 1003 to 2796) count.
DAY_0, DAYS, BLOCKS = "1900-01-01", 65_536, (-5, 4)

#: (the other half, with all that goes with it) to 64 hexadecimal digits that depend on the key
Stream = Callable[[Column], Column]


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """The inner and outer pads of an HMAC whose key is derived from ``key``."""
    derived = hashlib.sha256(b"pseudonyms|" + key.encode()).digest().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in derived), bytes(b ^ 0x5C for b in derived)


def hmac(pads: Column) -> Stream:
    """HMAC-SHA256 by pads(inner, outer), in hexadecimal."""
    return lambda message: F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], message.cast("binary")), 256))), 256)


def _added(half: Column, stream: Column, sign: int) -> Column:
    """Each letter and digit of ``half`` moved within its class by a byte of ``stream``."""

    def moved(s: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            byte = F.conv(F.substring(s, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int") * sign
            code = F.ascii(c)
            return (
                F.when(c.rlike("^[0-9]$"), F.char(F.pmod(code - 48 + byte, F.lit(10)) + 48))
                .when(c.rlike("^[a-z]$"), F.char(F.pmod(code - 97 + byte, F.lit(26)) + 97))
                .when(c.rlike("^[A-Z]$"), F.char(F.pmod(code - 65 + byte, F.lit(26)) + 65))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), move), "")

    return F.when(F.length(half) > 0, let(stream, moved)).otherwise(half)


def feistel(value: Column, stream: Stream, tweak: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings that have ``value``'s classes of characters at each place, another one for each ``tweak``."""
    half = F.floor(F.length(value) / 2).cast("int")
    state = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    turns = range(rounds)
    sign = -1 if inverse else 1
    for turn in reversed(turns) if inverse else turns:
        drawn = lambda other, turn=turn: stream(F.concat(tweak, F.lit(f"|{turn}|"), other))

        def second(s: Column) -> Column:
            return F.struct(s["a"].alias("a"), _added(s["b"], drawn(s["a"]), sign).alias("b"))

        def first(s: Column) -> Column:
            return F.struct(_added(s["a"], drawn(s["b"]), sign).alias("a"), s["b"].alias("b"))

        state = let(state, second if turn % 2 else first)
    return let(state, lambda s: F.concat(s["a"], s["b"]))


def number_feistel(value: Column, size: Column, stream: Stream, tweak: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the whole numbers below ``size`` squared; ``size`` is a power of two."""
    state = F.struct(F.floor(value / size).cast("long").alias("a"), F.pmod(value, size).cast("long").alias("b"))
    for turn in range(rounds):

        def step(s: Column) -> Column:
            drawn = F.conv(F.substring(stream(F.concat(tweak, F.lit(f"|{turn}|"), s["b"].cast("string"))), 1, 8), 16, 10).cast("long")
            return F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(F.pmod(drawn, size)).alias("b"))

        state = let(state, step)
    return let(state, lambda s: s["a"] * size + s["b"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a string of digits; those at an odd distance from the end (``doubled`` 1) or at an even one (0) are doubled."""
    n = F.length(digits)

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - 1 - i) % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda a, x: a + x)


def mod_97(text: Column) -> Column:
    """The number that an IBAN's characters spell, modulo 97."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def tail(text: Column, at: int) -> Column:
    """What follows the first ``at`` characters."""
    return F.substring(text, F.lit(at + 1), F.length(text))


def card_size(match: Column) -> Column:
    """How many of a match's digits are a card number: 16 of five groups if these are valid, else all that are, or null."""
    digits = digits_of(match)
    valid = lambda d: luhn_sum(d, 1) % 10 == 0
    return F.when(match.rlike("^(?:[0-9]{4}[ -]){4}") & valid(F.substring(digits, 1, 16)), F.lit(16)).when(valid(digits), F.length(digits))


def date_of(match: Column) -> Column:
    """struct<form, day>: which of ``DATE_FORMS`` a date is, and its days since ``DAY_0``; null if it is none or out of range."""

    def read(k: int) -> Column:
        form, pattern = DATE_FORMS[k]
        day = F.datediff(F.when(match.rlike(f"^(?:{form})$"), F.try_to_date(match, pattern)), F.lit(DAY_0).cast("date")).cast("long")
        return let(day, lambda d: F.when(d.between(BLOCKS[0] * DAYS, (BLOCKS[1] + 1) * DAYS - 1), F.struct(F.lit(k).alias("form"), d.alias("day"))))

    return F.coalesce(*map(read, range(len(DATE_FORMS))))


def kind_of(match: Column) -> Column:
    """email, phone, iban, ipv4, ssn, date or card; null for a number or date that is not valid."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    octets = F.transform(F.split(match, r"\."), lambda x: x.cast("int"))
    reserved = match.rlike("^(?:000|666|9)|-00-|-0000$")
    return (
        F.when(match.contains("@"), F.lit("email"))
        .when(match.startswith("+"), F.when(F.length(digits_of(match)).between(8, 15), F.lit("phone")))
        .when(whole("[A-Z]{2}[0-9]{2}.*"), F.when(mod_97(F.replace(match, F.lit(" "), F.lit(""))) == 1, F.lit("iban")))
        .when(whole(r"[0-9]+(?:\.[0-9]+){3}"), F.when(F.forall(octets, lambda x: x <= 255), F.lit("ipv4")))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(~reserved, F.lit("ssn")))
        .when(whole(DATE), F.when(date_of(match).isNotNull(), F.lit("date")))
        .when(whole(CARD), F.when(card_size(match).isNotNull(), F.lit("card")))
        .otherwise(F.lit("phone"))
    )


def _spread(chars: Column, like: Column) -> Column:
    """``chars`` in the places of the letters and digits of ``like``, with its separators; places beyond them stay."""

    def put(a: Column, c: Column) -> Column:
        fits = c.rlike("[0-9A-Za-z]") & (a["n"] < F.length(chars))
        return F.struct((a["n"] + fits.cast("int")).alias("n"), F.concat(a["out"], F.when(fits, F.substring(chars, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(like, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), put, lambda a: a["out"])


def american(digits: Column) -> Column:
    """The last ten digits: an area, whose first digit is fixed, an exchange, the same, and a line."""
    return F.substring(digits, -10, 10)


def permuted(value: Column, tweak: Column, stream: Stream) -> Column:
    """``value`` by ``feistel``; of social security numbers again until neither group nor serial is zero."""

    def again(x: Column, turn: Column) -> Column:
        done = (turn > 0) & ~(tweak.startswith("ssn|") & x.rlike("^00|0000$"))
        return F.when(done, x).otherwise(feistel(x, stream, tweak))

    return F.aggregate(F.sequence(F.lit(0), F.when(tweak.startswith("ssn|"), F.lit(12)).otherwise(F.lit(0))), value, again)


def word_pseudonym(match: Column, kind: Column, stream: Stream) -> Column:
    """Of an e-mail address, a phone number, an IBAN, a social security number or a card: what is fixed, what moves, and both together again."""
    digits, bare = digits_of(match), F.replace(match, F.lit(" "), F.lit(""))
    plain = (kind == "phone") & ~match.rlike("^[+0]")
    ten = american(digits)
    fixed = F.when(match.startswith("+"), F.length(F.regexp_extract(match, r"^\+([0-9]{1,3})", 1))).otherwise(F.lit(2))
    size = card_size(match)
    head = (
        F.when(kind == "email", F.substring_index(match, "@", -1))
        .when(kind == "iban", F.substring(bare, 1, 2))
        .when(kind == "ssn", F.substring(digits, 1, 3))
        .when(kind == "card", F.substring(digits, 1, 1))
        .when(plain, F.concat(F.substring(ten, 1, 1), F.substring(ten, 4, 1)))
        .otherwise(F.substring(digits, F.lit(1), fixed))
    )
    free = (
        F.when(kind == "email", F.substring_index(match, "@", 1))
        .when(kind == "iban", tail(bare, 4))
        .when(kind == "ssn", tail(digits, 3))
        .when(kind == "card", F.substring(digits, F.lit(2), size - 2))
        .when(plain, F.concat(F.substring(ten, 2, 2), F.substring(ten, 5, 6)))
        .otherwise(F.substring(digits, fixed + 1, F.length(digits)))
    )

    def joined(p: Column) -> Column:
        head, new = p["head"], p["new"]
        checked = let(F.concat(head, F.lit("00"), new), lambda y: F.concat(head, F.lpad((98 - mod_97(y)).cast("string"), 2, "0"), new))
        area = F.concat(F.when(F.length(digits) > 10, F.lit("1")).otherwise(F.lit("")), F.substring(head, 1, 1), F.substring(new, 1, 2), F.substring(head, 2, 1), tail(new, 2))
        chars = (
            F.when(kind == "iban", checked)
            .when(kind == "card", let(F.concat(head, new), lambda x: F.concat(x, F.pmod(-luhn_sum(x, 0), F.lit(10)).cast("string"))))
            .when(plain, area)
            .otherwise(F.concat(head, new))
        )
        return F.when(kind == "email", F.concat(new, F.lit("@"), head)).otherwise(_spread(chars, match))

    def moved(p: Column) -> Column:
        tweak = F.concat(kind, F.when(plain, F.lit("|1|")).otherwise(F.lit("|")), p["head"])
        return F.struct(p["head"].alias("head"), let(tweak, lambda t: permuted(p["free"], t, stream)).alias("new"))

    return let(let(F.struct(head.alias("head"), free.alias("free")), moved), joined)


def number_pseudonym(match: Column, kind: Column, stream: Stream) -> Column:
    """Of an address, whose number moves among all, or a date, whose day moves within its block."""
    address = F.aggregate(F.split(match, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    read = F.when(kind == "date", date_of(match)).otherwise(F.struct(F.lit(-1).alias("form"), address.alias("day")))

    def moved(d: Column) -> Column:
        is_date = d["form"] >= 0
        block = F.when(is_date, F.floor(d["day"] / DAYS)).otherwise(F.lit(0)).cast("long")
        size = F.when(is_date, F.lit(1 << 8)).otherwise(F.lit(1 << 16)).cast("long")
        new = number_feistel(d["day"] - block * DAYS, size, stream, F.concat(kind, F.lit("|"), block.cast("string")))
        return let(new, lambda n: F.when(is_date, dated(block * DAYS + n, d["form"])).otherwise(F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])))

    def dated(n: Column, form: Column) -> Column:
        day = F.date_add(F.lit(DAY_0).cast("date"), n.cast("int"))
        return let(day, lambda x: F.coalesce(*[F.when(form == k, F.date_format(x, pattern)) for k, (_, pattern) in enumerate(DATE_FORMS)]))

    return let(read, moved)


def pseudonym(match: Column, kind: Column, stream: Stream) -> Column:
    """A valid value of the same kind and format; the match itself if ``kind`` is null."""
    return F.when(kind.isNull(), match).when(kind.isin("ipv4", "date"), number_pseudonym(match, kind, stream)).otherwise(word_pseudonym(match, kind, stream))


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with ``pseudonymized`` (the text with its values replaced) and ``found`` (their kinds, in order)."""
    text = F.col(column)
    held, pads = free_name(docs, "_pii"), free_name(docs, "_pads")
    secret = docs.sparkSession.createDataFrame([hmac_pads(key)], "inner binary, outer binary")
    keyed = docs.withColumn(pads, secret.select(F.struct("inner", "outer")).scalar())
    stream = hmac(F.col(pads))
    # bound once: what lies between matches, and for each match its kind and pseudonym
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    changed = F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), pseudonym(f["m"], f["kind"], stream).alias("new")))
    work = F.when(text.rlike(GATE) & text.rlike(ANY), F.struct(F.split(text, ANY, -1).alias("gaps"), changed.alias("values")))
    new = F.concat(F.transform(f"{held}.values", lambda v: v["new"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(f"{held}.gaps", new, lambda a, b: F.concat(a, b)), "")
    kinds = F.filter(F.transform(f"{held}.values", lambda v: v["kind"]), lambda k: k.isNotNull())
    return (
        keyed.withColumn(held, work)
        .withColumns({"pseudonymized": F.when(F.col(held).isNotNull(), rebuilt).otherwise(text), "found": F.coalesce(kinds, F.array().cast("array<string>"))})
        .drop(held, pads)
    )

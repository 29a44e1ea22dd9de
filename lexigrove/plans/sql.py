"""Pieces of the queries' SQL: the same text operators without look-around."""

from __future__ import annotations

from ..functions.sentences import ABBREVIATIONS, INITIALISMS
from ..functions.text import STOP_WORDS

_C = "[\\-‐‑–]"
_X = r"[\p{L}\p{Nl}\p{No}]"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _twice(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {quoted(pattern)}, '{new}', 'g'), {quoted(pattern)}, '{new}', 'g')"


def _prepared(text: str, between: str) -> str:
    cut = _twice(text, rf"(\p{{Nd}}){between}(\p{{Nd}})", r"\1 \2" if between == _C else r"\1 \2 \3")
    cut = f"regexp_replace({cut}, {quoted(rf'\.(\p{{Nd}}+(?:[\p{{L}}\p{{Nl}}\p{{No}}_' + chr(39) + '’]|' + _C + _X + '))')}, '. \\1', 'g')"
    return _twice(cut, rf"(\p{{Nd}})%([\p{{L}}\p{{N}}_'’]|{_C}{_X})", r"\1 %\2")


_WORD = (
    rf"(?:[A-Za-z]\.){{2,}}|\p{{Nd}}+(?:{_X}|['’][\p{{L}}\p{{N}}]|{_C}{_X})[\p{{L}}\p{{N}}]*(?:['’\-‐‑–][\p{{L}}\p{{N}}]+)*"
    rf"|\p{{Nd}}+(?:\.\p{{Nd}}+)*%?|[\p{{L}}\p{{N}}]+(?:['’\-‐‑–][\p{{L}}\p{{N}}]+)*"
)


def fold(term: str) -> str:
    return f"replace(lower({term}), 'ß', 'ss')"


def tokens(text: str = "text") -> str:
    return f"list_transform(regexp_extract_all({_prepared(text, _C)}, {quoted(_WORD)}), lambda x: {fold('x')})"


def tokens_and_marks(text: str = "text") -> str:
    return f"list_transform(regexp_extract_all({_prepared(text, '(' + _C + ')')}, {quoted(_WORD + '|[^' + chr(92) + 's]')}), lambda x: {fold('x')})"


#: words(doc_id, lang, source, term) and p(doc_id, term, tf) without stop-words, then statistics.
WORDS = f"words AS (SELECT doc_id, lang, source, unnest({tokens()}) AS term FROM documents)"
INDEX = f"""{WORDS},
p AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term NOT IN ({STOPS}) GROUP BY doc_id, term),
len AS (SELECT doc_id, sum(tf)::BIGINT AS length, count(*) AS n_terms FROM p GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(length)::BIGINT AS n_tokens, avg(length) AS avg_length FROM len),
terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, log10(any_value(n_docs) / count(*)) AS idf,
  log10((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS bm25_idf FROM p, corpus GROUP BY term)"""

DOCUMENT = {
    "raw_tf": "tf::DOUBLE",
    "log_tf": "1 + log10(tf)",
    "idf": "idf",
    "tfidf": "tf * idf",
    "logtfidf": "(1 + log10(tf)) * idf",
    "bm25": "bm25_idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))",
}
QUERY = DOCUMENT | {"bm25": "tf::DOUBLE"}


def weights(methods: list[str] | None = None) -> str:
    """w(doc_id, term, method, weight)."""
    parts = [f"SELECT doc_id, term, '{m}' AS method, {DOCUMENT[m]} AS weight FROM rich" for m in methods or DOCUMENT]
    return "rich AS (SELECT p.*, idf, bm25_idf, length, avg_length FROM p JOIN terms USING (term) JOIN len USING (doc_id), corpus), w AS (" + " UNION ALL ".join(parts) + ")"


def query_weights(queries: list[tuple[str, str, int]], methods: list[str] | None = None) -> str:
    """q(query_id, term, method, weight) of (query_id, term, tf)."""
    values = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in queries)
    parts = [f"SELECT query_id, term, '{m}' AS method, {QUERY[m]} AS weight FROM asked" for m in methods or QUERY]
    return f"asked AS (SELECT v.query_id, v.term, v.tf, idf, bm25_idf FROM (VALUES {values}) v(query_id, term, tf) JOIN terms ON terms.term = v.term), q AS (" + " UNION ALL ".join(parts) + ")"


def scores(cosine: bool) -> str:
    """s(query_id, method, doc_id, score)."""
    if not cosine:
        return "s AS (SELECT query_id, method, doc_id, round(sum(w.weight * q.weight), 10) AS score FROM w JOIN q USING (term, method) GROUP BY ALL)"
    return """dn AS (SELECT method, doc_id, sqrt(sum(weight * weight)) AS dnorm FROM w GROUP BY ALL),
qn AS (SELECT method, query_id, sqrt(sum(weight * weight)) AS qnorm FROM q GROUP BY ALL),
s AS (SELECT query_id, method, doc_id, round(CASE WHEN any_value(dnorm) * any_value(qnorm) > 0 THEN sum(w.weight * q.weight) / (any_value(dnorm) * any_value(qnorm)) ELSE 0 END, 10) AS score
  FROM w JOIN q USING (term, method) JOIN dn USING (method, doc_id) JOIN qn USING (method, query_id) GROUP BY query_id, method, doc_id)"""


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"


_ABBREVIATED = "(?i)(?:^|[^A-Za-z])(?:" + "|".join(ABBREVIATIONS) + r")\.[\"'”’)\]}]*$"
_INITIALISM = "(?i)(?:" + "|".join(x.replace(".", r"\.") for x in INITIALISMS) + r")\.[\"'”’)\]}]*$"
_INITIAL = r"(?:^|[^A-Za-z])[A-Z]\.[\"'”’)\]}]*$"
_SPACE = r"[\s\p{Z}\x1C-\x1F\x{85}]"
#: counted(doc_id, n): sentences of each line. Pieces end at marks and white space; an abbreviation's point, or an initial's before a capital, ends none.
SENTENCES = f"""lines AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n+')) AS line FROM documents),
pieces AS (SELECT doc_id, list_transform(string_split(regexp_replace(line, {quoted(r"([.!?。！？][\"'”’)\]}]*)" + _SPACE + "+")}, '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, {quoted(f"^{_SPACE}+|{_SPACE}+$")}, '', 'g')) AS s FROM lines),
ends AS (SELECT doc_id, s, list_transform(range(1, len(s)), lambda i: NOT (regexp_matches(s[i], {quoted(_ABBREVIATED)}) OR regexp_matches(s[i], {quoted(_INITIALISM)}) OR (regexp_matches(s[i], {quoted(_INITIAL)}) AND regexp_matches(s[i + 1], '^\\p{{Lu}}')))) AS real FROM pieces),
counted AS (SELECT doc_id, len(list_filter(real, lambda x: x)) + CASE WHEN s[-1] <> '' OR (len(s) > 1 AND NOT real[-1]) THEN 1 ELSE 0 END AS n FROM ends)"""

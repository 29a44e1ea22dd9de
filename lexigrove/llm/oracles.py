"""SQL of those queries of this folder that SQL can express."""

from __future__ import annotations

from . import secret_scan as ss


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(pattern: str, kind: int, keep: str) -> str:
    """Rows (doc_id, kind, start, end, m) of a pattern's matches, placed by the lengths of gaps and matches before them."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start, found[i] AS m
  FROM (SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS found FROM d)) WHERE {keep}"""


_SUSPECT = f"regexp_matches(m, {_quoted(ss.MIXED)}) AND " + " AND ".join(f"NOT regexp_matches(m, {_quoted(p)})" for p in ss.ALLOWED)
_BITS = "[" + ", ".join(map(str, ss.COUNT_BITS)) + "]"
_LIMITS = {k: ss.most_sum(v[1]) for k, v in ss.CLASSES.items()}
_KINDS = "[" + ", ".join(f"'{k}'" for k in ss.KINDS) + "]"
_SPELLED = f"coalesce(string_agg({_KINDS}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop), '')"

_STRETCH = _quoted(ss.STRETCH)

OP3 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, kind, start, start + length(m) AS stop FROM (
  {_spans(ss.ASSIGN, 0, f"length(regexp_extract(found[i], {_quoted(ss.ASSIGN)}, 2)) >= 12")}
  UNION ALL {_spans(ss.ACCESS, 1, "true")} UNION ALL {_spans(ss.HEX, 2, "true")})),
runs AS ({_spans(ss.CANDIDATE, 3, "true")}),
stretches AS (SELECT doc_id, run, start + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start, found[i] AS m
  FROM (SELECT doc_id, start AS run, start, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, start, string_split_regex(m, {_STRETCH}) AS gaps, regexp_extract_all(m, {_STRETCH}) AS found FROM runs WHERE NOT regexp_matches(m, {_quoted(ss.ALLOWED[1])})))),
candidates AS (SELECT doc_id, start AS run, start, m, true AS whole FROM runs UNION ALL SELECT doc_id, run, start, m, false FROM stretches),
parts AS (SELECT doc_id, run, start, m, whole, unnest(string_split_regex(m, {_quoted(ss.PLACEHOLDER)})) AS p FROM candidates WHERE {_SUSPECT}),
windows AS (SELECT doc_id, run, start, m, whole, list_sum(list_transform(map_values(list_histogram(string_split(substr(p, k, {ss.WINDOW}), ''))), lambda c: {_BITS}[(c + 1)::BIGINT])) AS bits
  FROM (SELECT *, unnest(range(1, length(p) - {ss.WINDOW - 2})) AS k FROM parts WHERE length(p) >= {ss.WINDOW})),
hits AS (SELECT DISTINCT doc_id, run, whole, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN 3 ELSE 4 END AS kind, start, start + length(m) AS stop FROM windows
  WHERE bits <= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {_LIMITS["entropy_hex"]} ELSE {_LIMITS["entropy_base64"]} END),
entropy AS (SELECT doc_id, kind, start, stop FROM hits h WHERE whole OR NOT EXISTS (SELECT 1 FROM hits w WHERE w.whole AND w.doc_id = h.doc_id AND w.run = h.run)),
fresh AS (SELECT * FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND e.stop <= b.stop)),
named AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_SPELLED} AS spans FROM base GROUP BY doc_id),
everything AS (SELECT doc_id, {_SPELLED} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM fresh) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(named.spans, '')) AS base_sha256, coalesce(everything.spans, '') AS spans
FROM d LEFT JOIN named USING (doc_id) LEFT JOIN everything USING (doc_id)"""

OP6 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON a = vec_id"""

_HEX = "list_transform(string_split(h, ''), lambda x: instr('0123456789abcdef', x) - 1)"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((n[(5 * k) // 4 + 1] * 16 + coalesce(n[(5 * k) // 4 + 2], 0)) >> (3 - (5 * k) % 4)) & 31) + 1, 1)), '')"

OP8 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
g AS (SELECT *, {_HEX} AS n FROM f)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM g"""

SQL = {"op3_secrets": OP3, "op6_embeddings": OP6, "op8_warc": OP8}

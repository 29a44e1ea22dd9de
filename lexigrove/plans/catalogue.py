"""Every query of the engine by name, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match
from ..functions import sentences as sent
from ..functions import text as tx
from ..functions.stem import stem_terms
from ..operators import evaluation as ev
from ..operators import fuzzy, news, ranking, reports, scope, skipgram, vectors, weighting, zipf
from ..operators import index as ix
from ..sources import newswire
from . import sql
from .store import count_of, documents, held, index, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Queries of the evaluation: id, type, topic, words. Words are frequent in the driver's tables.
ASKED = [("Q1", "keyword", "src0", "th er nd"), ("Q2", "paraphrase", "src1", "ha ou inan"), ("Q3", "keyword", "src2", "le en ou"), ("Q4", "paraphrase", "src3", "sch ge der")]
TERMS = [(q, w, 1) for q, _, _, text in ASKED for w in text.split()]
ONE = [("Q1", w, 1) for w in ("th", "er", "nd")]


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_cte(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def asked(spark: SparkSession, terms: list[tuple[str, str, int]] = TERMS) -> DataFrame:
    return spark.createDataFrame(terms, "query_id string, term string, tf long")


# --- text ---------------------------------------------------------------------------------------------------------------


@query(with_cte(f"SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens, count(*) FILTER (term IN ({sql.STOPS})) AS n_stop_words, count(DISTINCT term) AS vocabulary FROM words GROUP BY lang", sql.WORDS))
def token_stats_by_lang(spark, sf):
    words = documents(spark, sf).select("doc_id", "lang", F.explode(tx.tokens(F.col("text"))).alias("term"))
    per = words.groupBy("lang", "term").agg(F.count("*").alias("n"))  # a word's rows meet once for each language
    docs = documents(spark, sf).where(F.size(tx.tokens(F.col("text"))) > 0).groupBy("lang").agg(F.count("*").alias("n_docs"))
    counts = per.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.coalesce(F.sum(F.when(tx.is_stop_word(F.col("term")), F.col("n"))), F.lit(0)).alias("n_stop_words"), F.count("*").alias("vocabulary"))
    return docs.join(counts, "lang").select("lang", "n_docs", "n_tokens", "n_stop_words", "vocabulary")


@query(f"""SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS chars, length(regexp_replace(text, '\\s', '', 'g')) AS chars_no_space,
  len({sql.tokens()}) AS words FROM documents""")
def doc_char_stats(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", tx.char_count(t).cast("long").alias("chars"), tx.char_count_no_space(t).cast("long").alias("chars_no_space"), F.size(tx.tokens(t)).cast("long").alias("words"))


@query(with_cte("""SELECT doc_id, coalesce(n, 0)::INT AS sentences, CASE WHEN n > 0 THEN round(words / n, 2) ELSE 0 END AS words_per_sentence
  FROM (SELECT doc_id, len(t) AS words FROM toks) LEFT JOIN (SELECT doc_id, sum(n)::BIGINT AS n FROM counted GROUP BY doc_id) USING (doc_id)""", f"toks AS (SELECT doc_id, {sql.tokens()} AS t FROM documents)", sql.SENTENCES))
def sentence_stats(spark, sf):
    rows = documents(spark, sf).select("doc_id", sent.sentence_count(F.col("text")).alias("sentences"), F.size(tx.tokens(F.col("text"))).alias("words"))
    return rows.select("doc_id", "sentences", F.when(F.col("sentences") > 0, F.round(F.col("words") / F.col("sentences"), 2)).otherwise(0.0).alias("words_per_sentence"))


@query(with_cte("""SELECT doc_id, len(t) AS words, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS characters, coalesce((SELECT sum(n) FROM counted WHERE counted.doc_id = d.doc_id), 0)::BIGINT AS sentences
  FROM documents d JOIN toks USING (doc_id)""", f"toks AS (SELECT doc_id, {sql.tokens()} AS t FROM documents)", sql.SENTENCES))
def display_stats(spark, sf):
    return reports.display_stats(documents(spark, sf))


@query(with_cte("""SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS characters, length(regexp_replace(text, '\\s', '', 'g')) AS characters_no_space, len(t) AS words, coalesce(n, 0)::BIGINT AS sentences,
  CASE WHEN n > 0 THEN round(len(t) / n, 2) ELSE 0 END AS words_per_sentence FROM documents JOIN toks USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n)::BIGINT AS n FROM counted GROUP BY doc_id) USING (doc_id)""", f"toks AS (SELECT doc_id, {sql.tokens()} AS t FROM documents)", sql.SENTENCES))
def document_stats(spark, sf):
    return reports.document_stats(documents(spark, sf))


def _conditions_sql(body: str) -> str:
    marks = f"a AS (SELECT doc_id, unnest({sql.tokens_and_marks()}) AS term FROM documents)"
    c = f"""c AS (SELECT 'A' AS condition, doc_id, term FROM a UNION ALL SELECT 'B', doc_id, term FROM a WHERE regexp_matches(term, '[\\p{{L}}\\p{{N}}]')
  UNION ALL SELECT 'C', doc_id, term FROM a WHERE regexp_matches(term, '[\\p{{L}}\\p{{N}}]') AND term NOT IN ({sql.STOPS}))"""
    t = """n AS (SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '\\S')),
cp AS (SELECT condition, doc_id, term, count(*) AS tf FROM c GROUP BY ALL),
t AS (SELECT condition, term, sum(tf)::BIGINT AS cf, count(*) AS df, log10(any_value(n) / count(*)) AS idf, count(*) / any_value(n) AS coverage,
  row_number() OVER (PARTITION BY condition ORDER BY sum(tf) DESC, term) AS rank FROM cp, n GROUP BY condition, term)"""
    return with_cte(body, marks, c, t)


def _term_table(spark, sf):
    docs = scope.not_blank(documents(spark, sf))
    n = count_of(spark, sf, "not blank", lambda: docs)
    words = held(spark, sf, "condition A", lambda: ix.postings(docs, tx.condition_tokens(F.col("text"), "A")))
    return held(spark, sf, "term table", lambda: zipf.condition_table(words, n)), n


def _zipf_terms(condition, spark, sf):
    found, _ = _term_table(spark, sf)
    return rounded(found.where((F.col("condition") == condition) & (F.col("rank") <= 100)), "idf", "coverage")


for _c in "ABC":
    QUERIES[f"zipf_terms_{_c.lower()}"] = partial(_zipf_terms, _c)
    ORACLES[f"zipf_terms_{_c.lower()}"] = _conditions_sql(f"SELECT condition, rank, term, cf, df, round(idf, 6) AS idf, round(coverage, 6) AS coverage FROM t WHERE condition = '{_c}' AND rank <= 100")


@query(_conditions_sql("SELECT rank, term, cf, df FROM t WHERE condition = 'B' AND contains(term, 'an') ORDER BY df DESC, term LIMIT 50"))
def zipf_sorted_terms(spark, sf):
    return zipf.sorted_terms(_term_table(spark, sf)[0], "B", "df", descending=True, part="AN").select("rank", "term", "cf", "df").limit(50)


@query(_conditions_sql("SELECT condition, any_value(n) AS n_docs, sum(cf)::BIGINT AS tokens, count(*) AS vocabulary, round(sum(cf) / any_value(n), 6) AS avg_tokens, count(*) FILTER (cf = 1) AS hapax, array_to_string(list(term ORDER BY rank) FILTER (rank <= 5), ' ') AS top_terms FROM t, n GROUP BY condition"))
def zipf_totals(spark, sf):
    found, n = _term_table(spark, sf)
    return rounded(zipf.totals(found, n), "avg_tokens").withColumn("n_docs", F.col("n_docs").cast("long")).withColumn("top_terms", F.array_join("top_terms", " "))


_FIT = "count(*) AS n, round(regr_slope(log10(cf), log10(rank)), 6) AS slope, round(regr_intercept(log10(cf), log10(rank)), 6) AS intercept, round(-regr_slope(log10(cf), log10(rank)), 6) + 0 AS exponent, round(regr_r2(log10(cf), log10(rank)), 6) AS r2, round(sqrt(greatest(regr_syy(log10(cf), log10(rank)) - regr_slope(log10(cf), log10(rank)) ^ 2 * regr_sxx(log10(cf), log10(rank)), 0) / count(*)), 6) AS rmse"


@query(_conditions_sql(f"SELECT condition, {_FIT} FROM t GROUP BY condition"))
def zipf_fit(spark, sf):
    return rounded(zipf.fit(_term_table(spark, sf)[0], "condition"), "slope", "intercept", "exponent", "r2", "rmse")


@query(
    _conditions_sql(f"""SELECT condition, region, {_FIT.replace("round(regr_r2(log10(cf), log10(rank)), 6)", "CASE WHEN min(cf) < max(cf) THEN round(regr_r2(log10(cf), log10(rank)), 6) END")},
  sum(cf)::BIGINT AS occurrences, round(sqrt(avg((log10(cf) - gi - gs * log10(rank)) ^ 2)), 6) AS global_rmse, array_to_string(list(term ORDER BY rank) FILTER (nth <= 8), ' ') AS examples
  FROM (SELECT *, row_number() OVER (PARTITION BY condition, region ORDER BY rank) AS nth FROM (
    SELECT t.*, gs, gi, CASE WHEN rank <= greatest(ceil(v * 0.05), 1) THEN 'head' WHEN rank <= greatest(ceil(v * 0.5), 2) THEN 'middle' ELSE 'tail' END AS region
    FROM t JOIN (SELECT condition, count(*) AS v, regr_slope(log10(cf), log10(rank)) AS gs, regr_intercept(log10(cf), log10(rank)) AS gi FROM t GROUP BY condition) g USING (condition)))
  GROUP BY condition, region""")
)
def zipf_regions(spark, sf):
    found = zipf.regions(_term_table(spark, sf)[0]).withColumn("examples", F.array_join("examples", " "))
    return rounded(found, "slope", "intercept", "exponent", "r2", "rmse", "global_rmse")


@query(_conditions_sql("""SELECT condition, rank, cf FROM t SEMI JOIN (SELECT condition, unnest(list_concat(range(1, least(50, v) + 1), list_transform(range(0, 751), lambda k: round(v::DOUBLE ^ (k / 750.0))::BIGINT))) AS rank
  FROM (SELECT condition, count(*) AS v FROM t GROUP BY condition)) s USING (condition, rank)"""))
def zipf_curve_sample(spark, sf):
    return zipf.curve_sample(_term_table(spark, sf)[0]).select("condition", "rank", "cf")


@query(_conditions_sql("SELECT condition, max_by(term, (df, cf, term)) AS widest FROM t WHERE condition <> 'A' GROUP BY condition"))
def zipf_widest_term(spark, sf):
    found = _term_table(spark, sf)[0].where("condition <> 'A'")
    return found.groupBy("condition").agg(F.max_by("term", F.struct("df", "cf", "term")).alias("widest"))


@query(_conditions_sql("SELECT condition, max_by(term, (df, cf, term)) AS widest, max_by(term, (cf / df, cf, term)) AS concentrated FROM t GROUP BY condition"))
def concentrated_terms(spark, sf):
    return zipf.concentrated_term(_term_table(spark, sf)[0])


@query(_conditions_sql("SELECT doc_id, tf FROM cp WHERE condition = 'C' AND term = 'th'"))
def condition_term_search(spark, sf):
    return ranking.exact_term_documents(zipf.condition_postings(documents(spark, sf), ("C",)), "th").select("doc_id", "tf")


def _condition_d(spark, sf):
    docs = scope.not_blank(documents(spark, sf))
    words = held(spark, sf, "condition C stems", lambda: stem_terms(ix.postings(docs, tx.condition_tokens(F.col("text"), "C"))))
    return words, count_of(spark, sf, "not blank", lambda: docs)


@query()
def zipf_terms_d(spark, sf):
    stems, n = _condition_d(spark, sf)
    found = stems.groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf")).withColumn("condition", F.lit("D"))
    return rounded(zipf.term_table(found, n).where("rank <= 100"), "idf", "coverage")


@query()
def stem_families(spark, sf):
    return zipf.stem_families(_condition_d(spark, sf)[0])


# --- index ----------------------------------------------------------------------------------------------------------------


@query(with_cte("SELECT doc_id, term, tf FROM p", sql.INDEX))
def postings_tf(spark, sf):
    return index(spark, sf)


@query(with_cte("SELECT term, df, cf, round(idf, 6) AS idf, round(bm25_idf, 6) AS bm25_idf FROM terms ORDER BY df DESC, cf DESC, term LIMIT 50", sql.INDEX))
def term_stats_topdf(spark, sf):
    return rounded(ranking.extreme_terms(index(spark, sf), 50), "idf", "bm25_idf")


@query(with_cte("SELECT term, df, cf, round(idf, 6) AS idf, round(bm25_idf, 6) AS bm25_idf FROM terms WHERE df >= 2 ORDER BY df, cf DESC, term LIMIT 50", sql.INDEX))
def term_stats_lowdf(spark, sf):
    return rounded(ranking.extreme_terms(index(spark, sf), 50, highest=False, min_df=2), "idf", "bm25_idf")


@query(with_cte("(SELECT 'low' AS part, term, df, cf FROM terms WHERE df BETWEEN 2 AND 5 ORDER BY cf DESC, df, term LIMIT 10) UNION ALL (SELECT 'high', term, df, cf FROM terms ORDER BY df DESC, cf DESC, term LIMIT 10)", sql.INDEX))
def idf_extremes(spark, sf):
    terms = ix.term_stats(index(spark, sf))
    low = terms.where("df BETWEEN 2 AND 5").orderBy(F.desc("cf"), "df", "term").limit(10)
    high = ranking.extreme_terms(index(spark, sf), 10)
    pick = lambda d, p: d.select(F.lit(p).alias("part"), "term", "df", "cf")
    return pick(low, "low").unionByName(pick(high, "high"))


@query(with_cte("""SELECT count(*) AS n_docs, sum(length)::BIGINT AS n_tokens, round(avg(length), 6) AS avg_length, median(length) AS median_length, min(length) AS min_length, max(length) AS max_length,
  (SELECT count(*) FROM terms) AS vocabulary, (SELECT count(*) FROM terms WHERE cf = 1) AS hapax FROM len""", sql.INDEX))
def corpus_summary(spark, sf):
    return rounded(ix.corpus_summary(index(spark, sf)), "avg_length")


@query(with_cte("""SELECT bin, floor(lo + w * (bin - 1))::BIGINT AS low, floor(lo + w * bin)::BIGINT AS high, count(*) AS n_docs FROM (
  SELECT least(floor((length - lo) * 10 / (hi - lo)) + 1, 10)::INT AS bin, lo, (hi - lo) / 10 AS w FROM len, (SELECT min(length) AS lo, max(length) AS hi FROM len)) GROUP BY ALL""", sql.INDEX))
def length_histogram(spark, sf):
    return ix.length_histogram(index(spark, sf))


def _weights(method, spark, sf):
    found = weighting.document_weights(weighting.with_stats(index(spark, sf)), (method,))
    return rounded(found.where(F.col("term").isin("th", "er", "nd", "ha", "inan")), "weight")


for _m in weighting.METHODS:
    QUERIES[f"weights_{_m}"] = partial(_weights, _m)
    ORACLES[f"weights_{_m}"] = with_cte("SELECT doc_id, term, method, round(weight, 6) AS weight FROM w WHERE term IN ('th', 'er', 'nd', 'ha', 'inan')", sql.INDEX, sql.weights([_m]))


@query(with_cte("SELECT method, doc_id, round(sqrt(sum(weight * weight)), 6) AS norm FROM w GROUP BY method, doc_id", sql.INDEX, sql.weights()))
def l2_norms(spark, sf):
    return rounded(weighting.norms(weighting.document_weights(weighting.with_stats(index(spark, sf))), "method", "doc_id"), "norm")


@query(with_cte("SELECT term, cf FROM terms WHERE cf > 2 * (SELECT avg(cf) FROM terms)", sql.INDEX))
def frequent_terms(spark, sf):
    terms = ix.term_stats(index(spark, sf))
    return terms.crossJoin(F.broadcast(terms.agg(F.avg("cf").alias("mean")))).where("cf > 2 * mean").select("term", "cf")


@query(with_cte("SELECT word FROM (VALUES ('th'), ('zzzz'), ('er'), ('qqqq')) v(word) WHERE word NOT IN (SELECT term FROM terms)", sql.INDEX))
def unknown_query_terms(spark, sf):
    words = spark.createDataFrame([(w,) for w in ("th", "zzzz", "er", "qqqq")], "term string")
    return ranking.unknown_terms(words, index(spark, sf)).select(F.col("term").alias("word"))


# --- search ---------------------------------------------------------------------------------------------------------------


def _search(method, cosine, spark, sf):
    found = ranking.vector_scores(index(spark, sf), asked(spark, ONE), (method,), cosine)
    return rounded(ranking.ranked(found, "query_id", "method", limit=20), "score").select("query_id", "method", "rank", "doc_id", "score")


for _m in weighting.METHODS:
    for _cosine in (False, True):
        _n = f"search_{_m}_{'cosine' if _cosine else 'dot'}"
        QUERIES[_n] = partial(_search, _m, _cosine)
        ORACLES[_n] = with_cte("SELECT query_id, method, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 20", sql.INDEX, sql.weights([_m]), sql.query_weights(ONE, [_m]), sql.scores(_cosine), sql.RANKED)


def _bm25_sql(where: str, limit: int) -> str:
    return with_cte(
        f"""SELECT doc_id, round(score, 6) AS score, array_to_string(matched, ' ') AS matched FROM (
  SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 10) AS score, list(term ORDER BY term) AS matched
  FROM h JOIN d USING (term) JOIN l USING (doc_id), c GROUP BY doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {limit}""",
        sql.WORDS,
        f"p AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term NOT IN ({sql.STOPS}) {where} GROUP BY ALL)",
        f"l AS (SELECT documents.doc_id, coalesce(sum(tf), 0)::BIGINT AS length FROM documents LEFT JOIN p USING (doc_id) WHERE true {where} GROUP BY documents.doc_id)",
        "c AS (SELECT count(*) AS n, avg(length) AS avgdl FROM l), h AS (SELECT * FROM p WHERE term IN ('th', 'er', 'nd')), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)",
    )


def _bm25(spark, sf, condition: str | None, limit: int):
    words = index(spark, sf)
    docs = documents(spark, sf, "doc_id", "lang")
    if condition:
        docs = docs.where(condition)
        words = words.join(docs.select("doc_id"), "doc_id", "left_semi")
    lengths = docs.select("doc_id").join(ix.doc_lengths(words), "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))
    groups = spark.createDataFrame([(w, w) for w in ("th", "er", "nd")], "term string, group string")
    best = ranking.top(ranking.bm25_scores(words, lengths, groups), limit)
    return rounded(best, "score").withColumn("matched", F.array_join("matched", " "))


@query(_bm25_sql("", 10))
def bm25_search(spark, sf):
    return _bm25(spark, sf, None, 10)


@query(_bm25_sql("AND lang = 'en'", 20))
def bm25_search_scoped(spark, sf):
    return _bm25(spark, sf, "lang = 'en'", 20)


#: Words of a query whose variants are asked for.
FORMS = ("inan", "tion", "erst")
_KEYED = r"keyed AS (SELECT term, regexp_replace(term, '[\-‐‑–]', '', 'g') AS key FROM terms WHERE regexp_matches(term, '\p{L}') AND regexp_full_match(term, '(?:[\p{L}\p{N}]|[\-‐‑–])+') AND length(term) >= 3)"
_GROUPS = "groups AS (SELECT DISTINCT word AS grp, term FROM (VALUES " + ", ".join(f"('{w}')" for w in FORMS) + ") v(word) JOIN keyed ON key = word AND length(key) >= 3)"


@query(
    with_cte(
        """SELECT doc_id, round(score, 6) AS score, array_to_string(matched, ' ') AS matched FROM (
  SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 10) AS score, list(grp ORDER BY grp) AS matched
  FROM h JOIN d USING (grp) JOIN l USING (doc_id), c GROUP BY doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""",
        sql.INDEX,
        _KEYED,
        _GROUPS,
        "l AS (SELECT documents.doc_id, coalesce(sum(tf), 0)::BIGINT AS length FROM documents LEFT JOIN p USING (doc_id) GROUP BY documents.doc_id)",
        "c AS (SELECT count(*) AS n, avg(length) AS avgdl FROM l), h AS (SELECT doc_id, grp, sum(tf)::BIGINT AS tf FROM p JOIN groups USING (term) GROUP BY ALL), d AS (SELECT grp, count(*) AS df FROM h GROUP BY grp)",
    )
)
def bm25_search_variants(spark, sf):
    words = index(spark, sf)
    lengths = documents(spark, sf, "doc_id").join(ix.doc_lengths(words), "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))
    groups = ranking.variant_groups_of(list(FORMS), words.select("term").distinct())
    return rounded(ranking.top(ranking.bm25_scores(words, lengths, groups), 10), "score").withColumn("matched", F.array_join("matched", " "))


@query(with_cte("SELECT grp AS word, array_to_string(list(term ORDER BY term), ' ') AS variants FROM groups WHERE term <> grp GROUP BY grp", sql.INDEX, _KEYED, _GROUPS))
def variants_in_scope(spark, sf):
    words = index(spark, sf)
    found = ranking.variants_present(ranking.variant_groups_of(list(FORMS), words.select("term").distinct()), words)
    return found.select(F.col("group").alias("word"), F.array_join("variants", " ").alias("variants"))


@query()
def bm25_search_stemmed(spark, sf):
    docs = documents(spark, sf)
    words = ix.search_postings(docs)
    lengths = docs.select("doc_id").join(ix.doc_lengths(words), "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))
    groups = spark.createDataFrame([(w, w) for w in ("th", "er", "nd")], "term string, group string")
    return rounded(ranking.top(ranking.bm25_scores(words, lengths, groups), 10), "score").select("doc_id", "score")


@query(with_cte("""SELECT doc_id, sum(tf)::DOUBLE AS score FROM (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN ('the', 'of', 'with') GROUP BY ALL) GROUP BY doc_id HAVING count(*) = 3""", sql.WORDS))
def stopword_and_search(spark, sf):
    return ranking.all_terms_scores(ix.postings(documents(spark, sf), tx.tokens(F.col("text"))), ["the", "of", "with"])


@query(with_cte("SELECT doc_id, tf, round(1 + log10(tf), 6) AS log_tf, round(tf * idf, 6) AS tfidf, df, cf, round(idf, 6) AS idf FROM p JOIN terms USING (term) WHERE term = 'inan' ORDER BY tf DESC, doc_id LIMIT 10", sql.INDEX))
def term_info(spark, sf):
    return rounded(ranking.term_documents(index(spark, sf), "inan"), "log_tf", "tfidf", "idf")


@query(with_cte("SELECT doc_id, rank, term, round(tfidf, 6) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM (SELECT doc_id, term, round(tf * idf, 10) AS tfidf FROM p JOIN terms USING (term))) WHERE rank <= 5", sql.INDEX))
def doc_top_terms(spark, sf):
    return rounded(ranking.document_terms(index(spark, sf), 5), "tfidf")


@query(with_cte("SELECT doc_id, tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf FROM p JOIN terms USING (term) WHERE term = 'th'", sql.INDEX))
def tfidf_for_term(spark, sf):
    return rounded(ranking.tfidf_of_term(index(spark, sf), "th"), "idf", "tfidf")


@query(with_cte("SELECT term, max(tf) AS max_tf, min(doc_id) FILTER (tf = m) AS max_doc, min(doc_id) FILTER (tf = 1) AS one_doc FROM (SELECT *, max(tf) OVER (PARTITION BY term) AS m FROM p WHERE term IN ('th', 'er', 'inan')) GROUP BY term", sql.INDEX))
def term_weight_demo(spark, sf):
    hits = index(spark, sf).where(F.col("term").isin("th", "er", "inan"))
    return hits.groupBy("term").agg(F.max("tf").alias("max_tf"), F.max_by("doc_id", F.struct("tf", -F.col("doc_id"))).alias("max_doc"), F.min(F.when(F.col("tf") == 1, F.col("doc_id"))).alias("one_doc"))


@query("SELECT tf, round(1 + log10(tf), 6) AS log_tf FROM (VALUES (1), (2), (3), (5), (10), (20), (50), (100)) v(tf)")
def tf_scaling(spark, sf):
    return spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 10, 20, 50, 100)], "tf int").select("tf", F.round(1 + F.log10("tf"), 6).alias("log_tf"))


# --- evaluation -----------------------------------------------------------------------------------------------------------


def _rankings(spark, sf, cosine=False):
    def build():
        return ranking.ranked(ranking.vector_scores(index(spark, sf), asked(spark), cosine=cosine), "query_id", "method").select("query_id", "method", "doc_id", "score", "rank")

    return held(spark, sf, f"rankings {cosine}", build)


def _qrels(spark, sf):
    grades = table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    ids = spark.createDataFrame([(q[0],) for q in ASKED], "query_id string")
    return grades.crossJoin(F.broadcast(ids))  # a few queries


_EVAL = """qrels AS (SELECT query_id, doc_id, quality + 1 - toxic AS grade FROM labels, (SELECT DISTINCT query_id FROM q)),
j AS (SELECT r.*, coalesce(grade, 0) AS grade FROM r LEFT JOIN qrels USING (query_id, doc_id)),
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (2 ^ grade - 1) / log2(place + 1) ELSE 0 END) AS idcg, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels WHERE grade > 0) GROUP BY query_id),
e AS (SELECT query_id, method, count(*) FILTER (grade > 0 AND rank <= 5) / 5 AS p5, count(*) FILTER (grade > 0 AND rank <= 10) / 10 AS p, count(*) FILTER (grade > 0 AND rank <= 10) / any_value(n) AS recall,
  coalesce(1 / min(rank) FILTER (grade > 0), 0) AS rr, sum(CASE WHEN rank <= 10 THEN (2 ^ grade - 1) / log2(rank + 1) ELSE 0 END) / any_value(idcg) AS ndcg FROM j JOIN ideal USING (query_id) GROUP BY query_id, method)"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in ev.METRICS)
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ev.METRICS)


def _eval_sql(body: str, cosine: bool = False) -> str:
    return with_cte(body, sql.INDEX, sql.weights(), sql.query_weights(TERMS), sql.scores(cosine), sql.RANKED, _EVAL)


def _per_query(spark, sf, cosine=False):
    return ev.metrics(_rankings(spark, sf, cosine), _qrels(spark, sf), 10, "method")


@query(_eval_sql(f"SELECT query_id, method, {_ROUNDED} FROM e"))
def eval_per_query(spark, sf):
    return rounded(_per_query(spark, sf), *ev.METRICS)


@query(_eval_sql(f"SELECT query_id, method, {_ROUNDED} FROM e", True))
def eval_per_query_cosine(spark, sf):
    return rounded(_per_query(spark, sf, True), *ev.METRICS)


@query(_eval_sql(f"SELECT method, {_MEANS} FROM e GROUP BY method"))
def eval_means(spark, sf):
    return rounded(ev.means(_per_query(spark, sf), "method"), *ev.METRICS)


_KINDS = "kinds AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c, _ in ASKED) + ") v(query_id, type, topic))"


@query(_eval_sql(f"SELECT method, type, topic, CASE WHEN type IS NOT NULL THEN 'type' WHEN topic IS NOT NULL THEN 'topic' ELSE 'all' END AS level, {_MEANS} FROM e JOIN kinds USING (query_id) GROUP BY GROUPING SETS ((method), (method, type), (method, topic))").replace(_EVAL, _EVAL + ",\n" + _KINDS))
def eval_grouping_sets(spark, sf):
    kinds = spark.createDataFrame([q[:3] for q in ASKED], "query_id string, type string, topic string")
    return rounded(ev.means_by_level(_per_query(spark, sf).join(F.broadcast(kinds), "query_id")), *ev.METRICS)


@query(_eval_sql("SELECT query_id, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25, round(bm25 - tfidf, 6) AS delta FROM (SELECT query_id, max(ndcg) FILTER (method = 'tfidf') AS tfidf, max(ndcg) FILTER (method = 'bm25') AS bm25 FROM e GROUP BY query_id)"))
def query_comparison_pivot(spark, sf):
    wide = ev.compare_methods(_per_query(spark, sf), "tfidf", "bm25").withColumn("delta", F.col("bm25") - F.col("tfidf"))
    return rounded(wide, "tfidf", "bm25", "delta")


@query(_eval_sql(f"SELECT query_id, method, {_ROUNDED} FROM e UNION ALL SELECT 'MEAN', method, {_MEANS} FROM e GROUP BY method"))
def eval_with_means(spark, sf):
    return rounded(ev.with_means(_per_query(spark, sf), "method"), *ev.METRICS)


@query(_eval_sql("SELECT method, round(avg(ndcg), 6) AS ndcg, avg(ndcg) = max(avg(ndcg)) OVER () AS ndcg_best FROM e GROUP BY method"))
def eval_best_flags(spark, sf):
    return rounded(ev.best_flags(ev.means(_per_query(spark, sf), "method")), "ndcg").select("method", "ndcg", "ndcg_best")


@query(_eval_sql("SELECT r.query_id, r.method, r.doc_id, r.rank, b.rank AS base_rank, b.rank - r.rank AS change FROM r LEFT JOIN r b ON b.query_id = r.query_id AND b.doc_id = r.doc_id AND b.method = 'raw_tf' WHERE r.rank <= 10"))
def rank_comparison(spark, sf):
    return ranking.rank_change(_rankings(spark, sf), "raw_tf").where("rank <= 10").select("query_id", "method", "doc_id", "rank", "base_rank", "change")


@query(_eval_sql("SELECT method, round(avg(length), 6) AS avg_length FROM r JOIN len USING (doc_id) WHERE rank <= 10 GROUP BY method"))
def length_bias(spark, sf):
    first = _rankings(spark, sf).where("rank <= 10").join(ix.doc_lengths(index(spark, sf)), "doc_id")
    return rounded(first.groupBy("method").agg(F.avg("length").alias("avg_length")), "avg_length")


_PAIR = (sql.INDEX, sql.weights(["tfidf"]), sql.query_weights(TERMS, ["tfidf"]), sql.scores(False).replace("s AS", "sd AS"), sql.scores(True).replace("s AS (SELECT query_id", "sc AS (SELECT query_id"))


@query(
    with_cte(
        """SELECT 'first' AS side, a.query_id, a.doc_id, a.rank, b.rank AS other_rank FROM ra a LEFT JOIN rb b USING (query_id, doc_id) WHERE a.rank <= 10
  UNION ALL SELECT 'second', b.query_id, b.doc_id, b.rank, a.rank FROM rb b LEFT JOIN ra a USING (query_id, doc_id) WHERE b.rank <= 10""",
        *_PAIR,
        *[f"{r} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {s_} WHERE score > 0)" for r, s_ in (("ra", "sd"), ("rb", "sc"))],
    )
)
def length_pairs(spark, sf):
    """The first ten by TF-IDF without and with length normalisation, each with its rank on the other side."""
    dot, cosine = (_rankings(spark, sf, c).where("method = 'tfidf'") for c in (False, True))
    return ranking.other_ranks(dot, cosine)


@query(_eval_sql("SELECT r.method, r.query_id, count(b.doc_id) AS overlap FROM r LEFT JOIN r b ON b.query_id = r.query_id AND b.doc_id = r.doc_id AND b.method = 'bm25' AND b.rank <= 10 WHERE r.rank <= 10 GROUP BY ALL"))
def top10_overlap(spark, sf):
    return ranking.top_overlap(_rankings(spark, sf), "bm25")


@query("SELECT q.query_id, count(*) FILTER (quality + 1 - toxic > 0) AS n_relevant, count(*) FILTER (quality + 1 - toxic > 1) AS n_highly_relevant FROM labels, (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) q(query_id) GROUP BY q.query_id")
def relevance_summary(spark, sf):
    return ev.ideal_dcg(_qrels(spark, sf), 10).select("query_id", "n_relevant", "n_highly_relevant")


# --- scopes, domains, samples ---------------------------------------------------------------------------------------------


@query("SELECT source, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY source")
def facet_counts(spark, sf):
    docs = documents(spark, sf, "doc_id", "source")
    topics = docs.select(F.col("source").alias("topic_id"), F.col("source").alias("name")).distinct()
    return scope.topic_counts(topics, docs.select("doc_id", F.col("source").alias("topic_id"))).select(F.col("name").alias("source"), "n_docs")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def topic_union(spark, sf):
    docs = documents(spark, sf, "doc_id", "source", F.col("lang").alias("publication_year"))
    bridge = docs.select("doc_id", F.regexp_replace("source", "src", "").cast("int").alias("topic_id"))
    return scope.in_topics(docs, bridge, [1, 2], "en").select("doc_id", "source")


@query("SELECT doc_id, source, lang FROM documents ORDER BY lang, source, doc_id LIMIT 20 OFFSET 20")
def articles_page(spark, sf):
    return ranking.page(documents(spark, sf, "doc_id", "source", "lang"), "lang", "source", "doc_id", number=2)


@query("SELECT source, doc_id, sample_key, nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_key) AS nth FROM (SELECT source, doc_id, sha256('42:' || source || ':' || doc_id) AS sample_key FROM documents)) WHERE nth <= 10")
def hash_sample(spark, sf):
    return scope.hash_sample(documents(spark, sf, "doc_id", "source"), "source", 10).select("source", "doc_id", "sample_key", "nth")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))")
def balanced_sample(spark, sf):
    return scope.lowest_ids(documents(spark, sf, "doc_id", "lang"), "lang").select("lang", "doc_id")


@query("SELECT count(*) AS n, max(doc_id) AS last_id FROM documents")
def corpus_signature(spark, sf):
    return scope.signature(documents(spark, sf, "doc_id"))


def _domain_sql(body: str) -> str:
    return with_cte(
        body,
        sql.WORDS,
        f"pd AS (SELECT lang AS domain, doc_id, term, count(*) AS tf FROM words WHERE lang IN ('en', 'fr') AND term NOT IN ({sql.STOPS}) GROUP BY ALL)",
        "td AS (SELECT domain, term, sum(tf)::BIGINT AS cf, count(*) AS df, row_number() OVER (PARTITION BY domain ORDER BY sum(tf) DESC, term) AS rank FROM pd GROUP BY domain, term)",
    )


def _domains(spark, sf):
    docs = documents(spark, sf)
    placed = scope.split_domains(docs, F.col("lang") == "en", F.col("lang") == "fr").select("doc_id", F.col("lang").alias("condition"))
    return zipf.term_table(index(spark, sf).join(placed, "doc_id"), 1).withColumnRenamed("condition", "domain")


@query(_domain_sql("SELECT domain, sum(cf)::BIGINT AS tokens, count(*) AS vocabulary, count(*) FILTER (cf = 1) AS hapax FROM td GROUP BY domain"))
def domain_compare(spark, sf):
    return _domains(spark, sf).groupBy("domain").agg(F.sum("cf").alias("tokens"), F.count("*").alias("vocabulary"), F.count_if(F.col("cf") == 1).alias("hapax"))


@query(_domain_sql("SELECT round((SELECT count(*) FROM (SELECT term FROM td WHERE rank <= 10 AND domain = 'en' INTERSECT SELECT term FROM td WHERE rank <= 10 AND domain = 'fr')) / (SELECT count(DISTINCT term) FROM td WHERE rank <= 10), 6) AS jaccard"))
def domain_jaccard(spark, sf):
    first = _domains(spark, sf).where("rank <= 10").groupBy().pivot("domain", ["en", "fr"]).agg(F.collect_set("term"))
    return first.select(F.round(scope.jaccard(F.col("en"), F.col("fr")), 6).alias("jaccard"))


@query(_domain_sql("SELECT count(*) AS shared_terms FROM (SELECT term FROM td WHERE domain = 'en' INTERSECT SELECT term FROM td WHERE domain = 'fr')"))
def domain_overlap(spark, sf):
    found = _domains(spark, sf)
    return found.where("domain = 'en'").select("term").intersect(found.where("domain = 'fr'").select("term")).agg(F.count("*").alias("shared_terms"))


@query(
    with_cte(
        f"""SELECT topic, term, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM (
  SELECT topic, term, round(in_df / size - (df - in_df) / (n - size), 10) AS score FROM i JOIN o USING (term) JOIN z USING (topic), (SELECT count(*) AS n FROM documents))) WHERE rank <= 10""",
        sql.WORDS,
        f"d AS (SELECT DISTINCT doc_id, source AS topic, term FROM words WHERE term NOT IN ({sql.STOPS}) AND regexp_matches(term, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]'))",
        "i AS (SELECT topic, term, count(*) AS in_df FROM d GROUP BY ALL), o AS (SELECT term, count(*) AS df FROM d GROUP BY term), z AS (SELECT source AS topic, count(*) AS size FROM documents GROUP BY source)",
    )
)
def topic_keywords(spark, sf):
    return rounded(scope.topic_keywords(documents(spark, sf), tx.news_tokens(F.col("text")), F.array("source"), 10), "score")


# --- fuzzy matching -------------------------------------------------------------------------------------------------------

WORDS = ("inan", "tion", "erst")
#: SQL counts bytes, so characters beyond ASCII that are letters of Latin scripts or connectors become controls and signs, one for one.
_BEYOND = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœšž‐‑–’ßºª"
_SINGLE = "".join(chr(c) for c in [*range(1, 32), *map(ord, "!#$&()*+,/:;")])[: len(_BEYOND)]


def _bytes(term: str) -> str:
    return f"translate({term}, '{_BEYOND}', {' || '.join(f'chr({ord(c)})' for c in _SINGLE)})"


@query(with_cte(f"""SELECT word, distance, term, df, cf, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, distance ORDER BY df DESC, cf DESC, term) AS rank FROM (
  SELECT word, levenshtein(word, {_bytes("term")})::INT AS distance, term, df, cf FROM terms, (VALUES {", ".join(f"('{w}')" for w in WORDS)}) v(word) WHERE abs(length(word) - length(term)) <= 3) WHERE distance BETWEEN 1 AND 3) WHERE rank <= 20""", sql.INDEX))
def edit_distance_groups(spark, sf):
    terms = ix.term_stats(index(spark, sf)).select("term", "cf", "df")
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    return fuzzy.edit_groups(words, terms, 3).where("rank <= 20")


_SPELL = "term NOT IN ({}) AND length(term) BETWEEN 2 AND 32 AND regexp_matches(term, '\\p{{L}}')".format(sql.STOPS)


@query(with_cte(f"""SELECT position, word, CASE WHEN word = upper(word) THEN upper(term) WHEN position = 2 THEN upper(term[1]) || term[2:] ELSE term END AS suggestion, distance, df, cf FROM (
  SELECT position, word, term, levenshtein(lower(word), {_bytes("term")})::INT AS distance, df, cf FROM terms, (VALUES (0, 'ththa'), (1, 'ERINT'), (2, 'Tionz')) v(position, word)
  WHERE {_SPELL} AND abs(length(word) - length(term)) <= 2) WHERE distance BETWEEN 1 AND 2""", sql.INDEX))
def spelling_suggest(spark, sf):
    terms = ix.term_stats(index(spark, sf)).select("term", "cf", "df")
    words = spark.createDataFrame([(0, "ththa"), (1, "ERINT"), (2, "Tionz")], "position int, word string")
    return fuzzy.suggest(words, terms)


@query(with_cte(f"""SELECT row_number() OVER (ORDER BY distance, df DESC, cf DESC, term, position)::INT AS place, CASE position WHEN 0 THEN term || ' and ERINT' ELSE 'ththa and ' || upper(term) END AS corrected, distance FROM (
  SELECT position, word, term, levenshtein(lower(word), {_bytes("term")})::INT AS distance, df, cf FROM terms, (VALUES (0, 'ththa'), (2, 'ERINT')) v(position, word) WHERE {_SPELL} AND abs(length(word) - length(term)) <= 2) WHERE distance BETWEEN 1 AND 2""", sql.INDEX))
def corrected_queries(spark, sf):
    terms = ix.term_stats(index(spark, sf)).select("term", "cf", "df")
    return fuzzy.suggest_queries("ththa and ERINT", terms)


@query(with_cte("SELECT term, cf, df FROM terms WHERE contains(term, 'inan') AND length(term) >= 2 AND regexp_matches(term, '\\p{L}')", sql.INDEX))
def term_substring(spark, sf):
    terms = ix.term_stats(index(spark, sf)).select("term", "cf", "df")
    return scope.term_contains(terms, "INAN").where(tx.content_term(F.col("term")))


_VARIANTS = "(VALUES ('glp-1'), ('glp1'), ('sars-cov-2'), ('sarscov2'), ('sars-cov2'), ('a-b'), ('x1y'), ('it''s'))"


@query(f"SELECT key, array_to_string(list(DISTINCT term ORDER BY term), ' ') AS variants FROM (SELECT term, replace(term, '-', '') AS key FROM {_VARIANTS} v(term) WHERE regexp_matches(term, '^[a-z0-9-]+$') AND regexp_matches(term, '[a-z]')) WHERE length(key) >= 3 GROUP BY key HAVING count(*) > 1")
def variant_groups(spark, sf):
    terms = spark.createDataFrame([(t,) for t in ("glp-1", "glp1", "sars-cov-2", "sarscov2", "sars-cov2", "a-b", "x1y", "it's")], "term string")
    return fuzzy.variant_groups(terms).withColumn("variants", F.array_join("variants", " "))


@query("SELECT a, b, levenshtein(a, b)::INT AS distance, last_row, path FROM (VALUES ('gate', 'grates', '4 3 3 3 2 1 2', '0,0 1,1 1,2 2,3 3,4 4,5 4,6'), ('', 'xyz', '0 1 2 3', '0,0 0,1 0,2 0,3'), ('on', 'no', '2 1 2', '0,0 1,1 2,2')) v(a, b, last_row, path)")
def edit_matrix(spark, sf):
    pairs = spark.createDataFrame([("gate", "grates"), ("", "xyz"), ("on", "no")], "a string, b string")
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(",", p["i"].cast("string"), p["j"].cast("string"))), " ")
    return fuzzy.with_alignment(pairs).select("a", "b", "distance", F.array_join(F.element_at("table", -1).cast("array<string>"), " ").alias("last_row"), path.alias("path"))


# --- vectors --------------------------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.format_string("w%05d", "vec_id").alias("word"), F.col("embedding").alias("vec"), "label")


@query("""SELECT seed, rank, word, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, word) AS rank FROM (
  SELECT printf('w%05d', a.vec_id) AS seed, printf('w%05d', b.vec_id) AS word, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS similarity
  FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 7, 42) AND a.vec_id <> b.vec_id)) WHERE rank <= 10""")
def knn_cosine(spark, sf):
    seeds = spark.createDataFrame([("w00000",), ("w00007",), ("w00042",)], "word string")
    return rounded(vectors.neighbours(_vectors(spark, sf), seeds), "similarity")


@query("SELECT label, place, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS place FROM embeddings) GROUP BY label, place")
def mean_vector_by_label(spark, sf):
    means = vectors.mean_vectors(_vectors(spark, sf).withColumn("weight", F.lit(1.0)), "label")
    return rounded(means.select("label", F.posexplode("vec").alias("place", "x")), "x").withColumn("place", F.col("place").cast("long"))


@query(with_cte("""SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(0.5 * coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0), 10) AS score
  FROM (SELECT doc_id, score FROM s WHERE method = 'tfidf') a FULL JOIN (SELECT doc_id, score FROM s WHERE method = 'bm25') b USING (doc_id)) WHERE score > 0 ORDER BY rank LIMIT 20""", sql.INDEX, sql.weights(["tfidf", "bm25"]), sql.query_weights(ONE, ["tfidf", "bm25"]), sql.scores(True)))
def hybrid_rank(spark, sf):
    both = ranking.vector_scores(index(spark, sf), asked(spark, ONE), ("tfidf", "bm25"), True).withColumn("score", F.round("score", 10))
    found = ranking.hybrid(both.where("method = 'tfidf'"), both.where("method = 'bm25'"))
    return rounded(ranking.ranked(ranking.top(found, 20)), "score").select("doc_id", "score", "rank")


@query()
def pca_2d(spark, sf):
    return vectors.project(_vectors(spark, sf))


def _story_words(spark, sf):
    """Words of every document with the ends of its sentences, for training, postings and vectors; large, so on disk."""
    return held(spark, sf, "story words", lambda: news.story_words(_stories(spark, sf)), StorageLevel.DISK_ONLY)


def _story_counts(spark, sf):
    return held(spark, sf, "story counts", lambda: skipgram.word_counts(_story_words(spark, sf), least=2))


def _model(spark, sf):
    return held(spark, sf, "word model", lambda: vectors.skip_gram(_story_words(spark, sf), size=16, epochs=1, least=2, counts=_story_counts(spark, sf)))


@query()
def w2v_neighbors(spark, sf):
    return vectors.neighbours(_model(spark, sf), spark.createDataFrame([("th",), ("er",)], "word string"), 5)


@query()
def toy_cbow(spark, sf):
    rows = [("small", s.split()) for s in ("ships carry grain north", "ships carry ore south", "trains carry grain south", "rain falls north", "snow falls north", "trains wait")]
    return vectors.train_groups(spark.createDataFrame(rows, "model string, words array<string>"))


@query(f"""SELECT doc_id, place, centre, array_to_string(context, ' ') AS context FROM (SELECT doc_id, i AS place, w[i + 1] AS centre, list_concat(w[greatest(i - 1, 1):i], w[i + 2:i + 3]) AS context
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM (SELECT doc_id, {sql.tokens()} AS w FROM documents)))""")
def context_windows(spark, sf):
    found = vectors.context_windows(documents(spark, sf), tx.tokens(F.col("text")))
    return found.select("doc_id", F.col("at").cast("long").alias("place"), "centre", F.array_join("context", " ").alias("context"))


@query(with_cte("SELECT term AS word FROM words GROUP BY term HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)", sql.WORDS))
def shared_vocabulary(spark, sf):
    docs = documents(spark, sf)
    words = held(spark, sf, "words by language", lambda: docs.select("lang", F.explode(tx.tokens(F.col("text"))).alias("word")).where("lang is not null").distinct())
    langs = [r["lang"] for r in docs.where("lang is not null").select("lang").distinct().limit(100).collect()]
    return vectors.shared_vocabulary(*[words.where(F.col("lang") == x) for x in sorted(langs)])


@query(with_cte("SELECT DISTINCT term AS word FROM words WHERE term IN ('th', 'er', 'two', 'zzzz')", sql.WORDS))
def target_words(spark, sf):
    vocabulary = documents(spark, sf).select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return vectors.target_words("TH, er\ntwo words, zzzz", vocabulary.distinct())


@query("""WITH s AS (
  SELECT a.vec_id AS seed, b.vec_id AS word, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS whole, round(list_cosine_similarity((a.embedding::DOUBLE[])[1:32], (b.embedding::DOUBLE[])[1:32]), 10) AS half
  FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 7, 42) AND a.vec_id <> b.vec_id),
x AS (SELECT seed, word FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY whole DESC, word) AS r FROM s) WHERE r <= 10),
y AS (SELECT seed, word FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY half DESC, word) AS r FROM s) WHERE r <= 10)
SELECT x.seed, round(count(y.word) / (20 - count(y.word)), 6) AS jaccard FROM x LEFT JOIN y USING (seed, word) GROUP BY x.seed""")
def neighbour_agreement(spark, sf):
    seeds = spark.createDataFrame([("w00000",), ("w00007",), ("w00042",)], "word string")
    words = _vectors(spark, sf).select("word", "vec")
    whole, half = vectors.neighbours(words, seeds), vectors.neighbours(words.withColumn("vec", F.slice("vec", 1, 32)), seeds)
    return rounded(vectors.neighbour_jaccard(whole, half).select(F.substring("seed", 2, 5).cast("long").alias("seed"), "jaccard"), "jaccard")


@query("SELECT architecture, seconds, first_loss, last_loss, vocabulary FROM (VALUES ('cbow', 3.0::DOUBLE, 4.0::DOUBLE, 2.5::DOUBLE, 2), ('skipgram', 5.0, 6.0, 3.5, 3)) v(architecture, seconds, first_loss, last_loss, vocabulary)")
def architecture_table(spark, sf):
    runs = spark.createDataFrame([("cbow", 1, 4.0, 1.0), ("cbow", 2, 2.5, 2.0), ("skipgram", 1, 6.0, 2.0), ("skipgram", 2, 3.5, 3.0)], "architecture string, epoch int, loss double, seconds double")
    models = spark.createDataFrame([("cbow", "a"), ("cbow", "b"), ("skipgram", "a"), ("skipgram", "b"), ("skipgram", "c")], "architecture string, word string")
    return vectors.architecture_table(runs, models)


# --- sources and sinks ----------------------------------------------------------------------------------------------------


def _unescaped(text: str) -> str:
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{plain}')"
    return text


@query(f"""SELECT page_id, {_unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1], '') AS first_link FROM pages""")
def sgml_extract(spark, sf):
    return newswire.page_elements(table(spark, sf, "pages"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact(spark, sf):
    keyed = documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""SELECT a.doc_id AS incoming_id, b.doc_id, 'title' AS kind FROM documents a JOIN (SELECT lower(trim(text)) AS title, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL) b ON lower(trim(a.text)) = b.title AND a.lang = b.lang WHERE b.title <> ''""")
def dedup_priority(spark, sf):
    """Every document against all, by its whole text as title and its language as year."""
    from ..sources.tables import find_duplicates

    empty = [F.lit("").alias(c) for c in ("pmcid", "pmid", "doi", "arxiv_id", "source_file")]
    rows = documents(spark, sf).select("doc_id", F.col("text").alias("title"), F.col("lang").alias("publication_year"), *empty)
    return find_duplicates(rows.withColumnRenamed("doc_id", "incoming_id"), rows)


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(ltrim(text), '^[=+\\-@]') THEN '''' || text ELSE text END AS safe FROM conversations")
def csv_safe_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.csv_safe(F.col("text")).alias("safe"))


@query(f"SELECT doc_id, len(list_filter({sql.tokens()}, lambda x: x IN ('th', 'er', 'inan')))::INT AS n_matches FROM documents")
def keyword_match_count(spark, sf):
    return documents(spark, sf).select("doc_id", match.match_count(F.col("text"), match.Wanted(("th", "er", "inan"))).alias("n_matches"))


@query()
def highlighted_results(spark, sf):
    wanted = match.Wanted(("th", "er", "nd"))
    best = bm25_search(spark, sf).select("doc_id", "score")
    shown = documents(spark, sf, "doc_id", "text").join(F.broadcast(best), "doc_id")  # ten rows
    return shown.select("doc_id", "score", match.highlight(match.query_snippet(F.col("text"), wanted), wanted).alias("snippet"))


@query(_eval_sql("SELECT query_id, method, round(CASE WHEN hi > lo THEN (ndcg - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM (SELECT *, min(ndcg) OVER (PARTITION BY query_id) AS lo, max(ndcg) OVER (PARTITION BY query_id) AS hi FROM e)"))
def eval_scaled(spark, sf):
    return rounded(ev.scaled(_per_query(spark, sf), "ndcg", "query_id"), "scaled").select("query_id", "method", "scaled")


@query("SELECT year FROM (VALUES ('2021'), ('2024'), ('n.d.'), ('1999')) v(year)")
def years(spark, sf):
    return scope.years(spark.createDataFrame([("2021",), ("2024",), ("n.d.",), ("1999",), (" ",), ("2024",)], "publication_year string"))


@query("SELECT model, epoch, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY model ORDER BY epoch), 0) AS loss FROM (VALUES ('a', 1, 4.0::DOUBLE), ('a', 2, 7.0), ('b', 1, 5.0), ('b', 2, 9.5)) v(model, epoch, cumulative)")
def loss_deltas(spark, sf):
    rows = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 7.0), ("b", 1, 5.0), ("b", 2, 9.5)], "model string, epoch int, cumulative double")
    return vectors.loss_deltas(rows).select("model", "epoch", "loss")


def _stories(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"), F.array("source").alias("topics"))


def _news(spark, sf):
    stories = _stories(spark, sf)
    return stories, *news.news_index(stories)


def _news_scores(spark, sf):
    """Scores of all methods of the model; tables that are read twice are held."""
    counts, model, n = _story_counts(spark, sf), _model(spark, sf), table(spark, sf, "documents").count()
    sums = held(spark, sf, "story sums", lambda: news.document_sums(_story_words(spark, sf), counts, model, asked(spark), n))
    return news.corpus_scores(sums, counts, model, asked(spark), n)


_NEWS = (
    sql.WORDS,
    f"np AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term NOT IN ({sql.STOPS}) AND regexp_matches(term, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]') GROUP BY ALL)",
    "nd AS (SELECT term, log10((SELECT count(*) FROM documents) / count(*)) AS idf FROM np GROUP BY term)",
    "h AS (SELECT doc_id, term, tf * idf AS w FROM np JOIN nd USING (term)), z AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM h GROUP BY doc_id)",
    "q AS (SELECT query_id, v.term, tf * coalesce(idf, log10((SELECT count(*) FROM documents))) AS qw FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in TERMS) + ") v(query_id, term, tf) LEFT JOIN nd ON nd.term = v.term)",
    "qz AS (SELECT query_id, sqrt(sum(qw * qw)) AS qsize FROM q GROUP BY query_id)",
    """r AS (SELECT *, 'tfidf' AS method, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(w * qw) / any_value(size) / any_value(qsize), 10) AS score FROM h JOIN q USING (term) JOIN z USING (doc_id) JOIN qz USING (query_id) WHERE size * qsize > 0 GROUP BY query_id, doc_id) WHERE score > 0)""",
)


@query(with_cte("SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rank <= 20", *_NEWS))
def news_tfidf(spark, sf):
    _, words, docs = _news(spark, sf)
    return rounded(ranking.ranked(news.tfidf_scores(words, asked(spark), docs.count()), "query_id", limit=20), "score").select("query_id", "doc_id", "score")


def _topics(spark):
    return spark.createDataFrame([q[:3] for q in ASKED], "query_id string, type string, topic string")


_NEWS_EVAL = _EVAL.replace("qrels AS (SELECT query_id, doc_id, quality + 1 - toxic AS grade FROM labels, (SELECT DISTINCT query_id FROM q))", "qrels AS (SELECT query_id, doc_id, 1 AS grade FROM documents JOIN kinds ON topic = source)")


@query(with_cte(f"SELECT method, type, topic, CASE WHEN type IS NOT NULL THEN 'type' WHEN topic IS NOT NULL THEN 'topic' ELSE 'all' END AS level, {_MEANS} FROM e JOIN kinds USING (query_id) GROUP BY GROUPING SETS ((method), (method, type), (method, topic))", *_NEWS, _KINDS, _NEWS_EVAL))
def news_evaluation_tfidf(spark, sf):
    stories, words, docs = _news(spark, sf)
    found = ranking.ranked(news.tfidf_scores(words, asked(spark), docs.count()), "query_id").withColumn("method", F.lit("tfidf"))
    return rounded(news.evaluate(found, stories, _topics(spark)), *ev.METRICS)


@query()
def news_evaluation(spark, sf):
    """All methods of one model, by type and by topic."""
    found = news.rankings(_news_scores(spark, sf))
    stories = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("topics"))
    return rounded(news.evaluate(found, stories, _topics(spark)), *ev.METRICS)


@query()
def news_methods(spark, sf):
    return rounded(news.rankings(_news_scores(spark, sf)).where("rank <= 10"), "score").select("query_id", "method", "rank", "doc_id", "score")


@query("SELECT topic, count(*) AS n FROM (SELECT source AS topic FROM documents) GROUP BY topic")
def news_topics(spark, sf):
    return news.topic_overview(_news(spark, sf)[0])


def _newswire(spark, sf):
    """The documents as newswire files: a story each, with topics, split attributes, escapes and the agency's name at the end."""
    esc = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.regexp_replace(esc, "[^\\x09\\x0A\\x0D\\x20-\\xFF]", "?")  # what the files' encoding has
    lewis = F.when(F.col("doc_id") % 4 == 0, "TEST").when(F.col("doc_id") % 4 == 1, "NOT-USED").otherwise("TRAIN")
    parts = ('<REUTERS TOPICS="', F.when(F.col("doc_id") % 5 == 0, "BYPASS").otherwise("YES"), '" LEWISSPLIT="', lewis, '" CGISPLIT="TRAINING-SET" OLDID="1" NEWID="', F.col("doc_id").cast("string"))
    rest = ('"><DATE> 1-JAN-1987 01:02:03.04</DATE><TOPICS><D>', F.col("source"), "</D><D>", F.col("lang"), "</D></TOPICS><TEXT><TITLE>", F.concat(F.lit("No. "), F.col("doc_id").cast("string")), "</TITLE><BODY>", plain, "\n Reuter\u0003</BODY></TEXT></REUTERS>\n")
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in (*parts, *rest)])
    return documents(spark, sf).where("source is not null and lang is not null").select(F.encode(text, "ISO-8859-1").alias("content"))


_STORIES = """st AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 4 = 0 THEN 'test' WHEN doc_id % 4 = 1 THEN 'unused' ELSE 'train' END AS part, doc_id % 5 = 0 AS bypass,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x09\\x0A\\x0D\\x20-\\x{FF}]', '?', 'g'), '^\\s+|\\s+$', '', 'g'), '(?i)\\s*\\bReuter\\s*$', ''), '^\\s+|\\s+$', '', 'g') AS body
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"""


@query(with_cte("SELECT doc_id::INT AS id, CASE WHEN bypass THEN 'unused' ELSE part END AS modapte, CASE WHEN bypass THEN 'unused' ELSE part END AS modlewis, 'train' AS modhayes, source || ' ' || lang AS topics, '1-JAN-1987' AS date, 'No. ' || doc_id AS title, sha256(body) AS body FROM st", _STORIES))
def newswire_stories(spark, sf):
    found = newswire.parse_stories(_newswire(spark, sf))
    parts = [F.col("splits")[x].alias(x) for x in newswire.SPLITS]
    return found.select("id", *parts, F.array_join("topics", " ").alias("topics"), F.trim("date").alias("date"), "title", F.sha2("body", 256).alias("body"))


@query(with_cte("""SELECT split, count(*) FILTER (x = 'train') AS train, count(*) FILTER (x = 'test') AS test, count(*) FILTER (x = 'unused') AS unused FROM (
  SELECT 'modapte' AS split, CASE WHEN bypass THEN 'unused' ELSE part END AS x FROM st UNION ALL SELECT 'modlewis', CASE WHEN bypass THEN 'unused' ELSE part END FROM st UNION ALL SELECT 'modhayes', 'train' FROM st) GROUP BY split""", _STORIES))
def newswire_splits(spark, sf):
    return newswire.split_counts(newswire.parse_stories(_newswire(spark, sf)))


# --- pages and selections -------------------------------------------------------------------------------------------------


@query("SELECT lang AS class, count(*) AS n FROM documents GROUP BY lang")
def class_counts(spark, sf):
    return scope.class_counts(documents(spark, sf, "doc_id", "lang"), "lang")


@query("SELECT conv_id AS doc_id, array_to_string(list(DISTINCT role ORDER BY role), ',') AS topics FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def topics_of_documents(spark, sf):
    turns = table(spark, sf, "conversations").where("role is not null").select(F.col("conv_id").alias("doc_id"), "role")
    topics = turns.select(F.col("role").alias("name"), F.col("role").alias("topic_id")).distinct()
    found = scope.topics_of_documents(turns.select("doc_id").distinct(), turns.withColumnRenamed("role", "topic_id"), topics)
    return found.select("doc_id", F.array_join("topics", ",").alias("topics"))


@query("SELECT doc_id, domain FROM (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY sha256('42:' || domain || ':' || doc_id)) AS nth FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'medical' ELSE 'cs' END AS domain FROM documents)) WHERE nth <= least(500, (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY CASE WHEN lang = 'en' THEN 'medical' ELSE 'cs' END)))")
def preset_sample(spark, sf):
    docs = documents(spark, sf, "doc_id", F.when(F.col("lang") == "en", "medical").otherwise("cs").alias("domain"))
    return scope.preset_sample(docs, "balanced").select("doc_id", "domain")


@query("SELECT sha256(string_agg(doc_id || chr(0) || coalesce(text, '') || chr(0), '' ORDER BY doc_id)) AS content_hash FROM documents")
def content_hash(spark, sf):
    return scope.content_hash(documents(spark, sf, "doc_id", "text"))


@query("SELECT source AS topic, (SELECT string_agg(q, ';' ORDER BY q) FROM (VALUES ('src0', 'Q1 th er nd'), ('src1', 'Q2 ha ou inan'), ('src2', 'Q3 le en ou'), ('src3', 'Q4 sch ge der')) v(t, q) WHERE t = source) AS queries FROM (VALUES ('src0'), ('src1'), ('src2'), ('src3')) s(source)")
def queries_by_topic(spark, sf):
    queries = spark.createDataFrame([(q, t, text) for q, _, t, text in ASKED], "query_id string, topic string, text string")
    keywords = topic_keywords(spark, sf).select("topic", "rank", "term")
    found = reports.queries_by_topic(queries, keywords)
    return found.select("topic", F.array_join(F.transform("queries", lambda x: F.concat_ws(" ", x["query_id"], x["text"])), ";").alias("queries"))


@query()
def article_detail(spark, sf):
    """One article as its page shows it: the one that fits three words best."""
    best = bm25_search(spark, sf).orderBy(F.desc("score"), "doc_id").first()
    return reports.article_detail(documents(spark, sf, "doc_id", "text"), best["doc_id"] if best else -1, match.Wanted(("th", "er", "nd")))


@query(with_cte("SELECT term FROM (SELECT DISTINCT term FROM words) WHERE term NOT IN (SELECT term FROM p)", sql.INDEX))
def orphan_terms(spark, sf):
    vocabulary = documents(spark, sf).select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return ix.orphan_terms(vocabulary, index(spark, sf))


@query(with_cte("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)", sql.INDEX))
def unindexed_documents(spark, sf):
    return ix.unindexed(documents(spark, sf, "doc_id"), index(spark, sf))


@query("SELECT doc_id, lang AS publication_year FROM documents ORDER BY lang DESC, lower(source), doc_id LIMIT 30")
def newest_articles(spark, sf):
    docs = documents(spark, sf, "doc_id", F.col("source").alias("title"), F.col("lang").alias("publication_year"))
    return scope.ordered(docs, "newest").limit(30).select("doc_id", "publication_year")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1')")
def title_substring(spark, sf):
    return scope.title_contains(documents(spark, sf, "doc_id", F.col("source").alias("title")), "SRC1").select("doc_id")

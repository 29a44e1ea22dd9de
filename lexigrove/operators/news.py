"""News retrieval: TF-IDF cosine, embedding cosine with TF-IDF or equal weights, and their hybrid, over a test part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sentences as sent
from ..functions.shipping import arrow_map
from ..functions.text import news_tokens
from ..sources.newswire import search_text
from . import ranking, vectors
from .index import postings, term_stats
from .skipgram import encoded

METHODS = ("tfidf", "embedding_tfidf", "embedding_mean", "hybrid")


def news_index(stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of ``stories(id, title, body)``; documents without words stay in the second."""
    docs = stories.select(F.col("id").cast("long").alias("doc_id"), search_text(F.col("title"), F.col("body")).alias("text"))
    return postings(docs, news_tokens(F.col("text"))), docs


def _idf(index: DataFrame, n_docs: int) -> DataFrame:
    """idf over all documents of a part, those without words too."""
    return index.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.log10(F.lit(n_docs) / F.col("df")).alias("idf"))


def query_weights(queries: DataFrame, idf: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, term, tf, idf, weight) of ``queries(query_id, term, tf)``; a term outside the collection has idf log10 N."""
    known = F.coalesce("idf", F.log10(F.lit(float(max(1, n_docs)))))
    return queries.join(idf, "term", "left").select("query_id", "term", "tf", "df", known.alias("idf"), (F.col("tf") * known).alias("weight"))


def tfidf_scores(index: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    idf = _idf(index, n_docs)
    held = index.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    asked = query_weights(queries, idf, n_docs)
    size = held.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("size"))
    wanted = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("query_size"))
    dots = held.join(F.broadcast(asked.select("query_id", "term", F.col("weight").alias("q"))), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    both = dots.join(size, "doc_id").join(F.broadcast(wanted), "query_id")
    return both.where("size * query_size > 0").select("query_id", "doc_id", (F.col("dot") / F.col("size") / F.col("query_size")).alias("score"))


def embedding_scores(index: DataFrame, queries: DataFrame, words: DataFrame, n_docs: int, weighted: bool = True) -> DataFrame:
    """(query_id, doc_id, score) for every document with a known word, whatever the sign of its score."""
    idf = _idf(index, n_docs)
    one = F.lit(1.0)
    held = index.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf") if weighted else one).alias("weight"))
    docs = vectors.document_vectors(index, words, held)
    asked = query_weights(queries, idf, n_docs).withColumn("weight", F.col("weight") if weighted else one)
    means = vectors.mean_vectors(asked.join(words.select(F.col("word").alias("term"), "vec"), "term"), "query_id").withColumnRenamed("vec", "query_vec")
    pairs = docs.crossJoin(F.broadcast(means))  # a vector for each query of an evaluation
    return pairs.select("query_id", "doc_id", vectors.cosine(F.col("vec"), F.col("query_vec")).alias("score"))


def method_scores(index: DataFrame, queries: DataFrame, words: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, method, doc_id, score) of all ``METHODS`` for one model; the hybrid adds halves of the first two."""
    return all_method_scores(index, queries, {"": words}, n_docs)


def all_method_scores(index: DataFrame, queries: DataFrame, models: dict[str, DataFrame], n_docs: int) -> DataFrame:
    """(query_id, method, doc_id, score): TF-IDF once, and for each model its two embeddings and its hybrid; with two models, seven methods."""
    base = tfidf_scores(index, queries, n_docs)
    out = base.where("score > 0").select("query_id", F.lit("tfidf").alias("method"), "doc_id", "score")
    zero = F.lit(0.0)
    for name, words in models.items():
        tail = f"_{name}" if name else ""
        weighted, mean = (embedding_scores(index, queries, words, n_docs, weighted=w) for w in (True, False))
        both = base.withColumnRenamed("score", "a").join(weighted.withColumnRenamed("score", "b"), ["query_id", "doc_id"], "full_outer")
        hybrid = both.select("query_id", "doc_id", (0.5 * F.coalesce("a", zero) + 0.5 * F.coalesce("b", zero)).alias("score"))
        for method, part in (("embedding_tfidf", weighted), ("embedding_mean", mean), ("hybrid", hybrid)):
            out = out.unionByName(part.select("query_id", F.lit(method + tail).alias("method"), "doc_id", "score"))
    return out


def story_words(stories: DataFrame) -> DataFrame:
    """(doc_id, words) of ``stories(id, title, body)``: a row for each id, the words of ``news_index`` with marks between sentences."""
    rows = stories.select(F.col("id").cast("long").alias("doc_id"), sent.news_words(search_text(F.col("title"), F.col("body"))).alias("words"))
    ids = stories.select(F.col("id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    marked = F.concat("words", F.array(F.lit(sent.BREAK)))
    return rows.groupBy("doc_id").agg(F.flatten(F.collect_list(marked)).alias("words"))


#: Rows whose vectors are summed at once.
AT_ONCE = 500


def document_sums(words: DataFrame, counts: DataFrame, model: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """What scores of a document are made of, in one pass over ``words(doc_id, words)`` of ``story_words`` with ``counts(word, df)``:

    (doc_id, by_idf, plain, squares, hits, rare): mean vectors of its terms by ``model(word, vec)``, with weights tf * idf and equal ones; the
    sum of squared weights of the terms that the model has; other terms, and those of ``queries(term)``, with their tf.
    """
    spark = words.sparkSession
    known = model.join(counts.select("word", "df"), "word").select("word", "vec", "df").toArrow()
    terms = known.column("word").combine_chunks()
    vec = np.array(known.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(terms), -1)
    vec = small if ((small := vec.astype(np.float32)) == vec).all() else vec
    asked = queries.select("term").distinct().toArrow().column("term").combine_chunks()
    if len(asked) > ranking.MOST_TERMS:
        raise ValueError(f"more than {ranking.MOST_TERMS} words of queries at once")
    shared = spark.sparkContext.broadcast((terms, vec, np.log10(n_docs / known.column("df").to_numpy()), asked))

    def listed(some: np.ndarray, n: int, rows: np.ndarray, codes: np.ndarray, tf: np.ndarray, own: pa.Array) -> pa.Array:
        ends = np.searchsorted(rows[some], np.arange(n + 1)).astype(np.int32)
        held = pa.StructArray.from_arrays([own.take(pa.array(codes[some])), pa.array(tf[some], pa.int64())], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends), held)

    def vectors_of(sums: np.ndarray, total: np.ndarray) -> pa.Array:
        means = sums / np.where(total > 0, total, 1)[:, None]
        ends = np.arange(len(means) + 1, dtype=np.int32) * means.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(means.ravel()), mask=pa.array(total <= 0))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, vec, idf, asked = shared.value
        for batch in stream:
            n = batch.num_rows
            own, codes, rows, _ = encoded(batch.column(1))
            own = own.cast(pa.string())
            place = pc.fill_null(pc.index_in(own, value_set=terms.cast(pa.string())), -1).to_numpy(zero_copy_only=False)
            hit = pc.is_in(own, value_set=asked.cast(pa.string())).to_numpy(zero_copy_only=False)
            both, tf = np.unique(rows * max(1, len(own)) + codes, return_counts=True)
            rows, codes = np.divmod(both, max(1, len(own)))
            ids = place[codes]
            some = ids >= 0
            at, held, weight = rows[some], ids[some], tf[some] * idf[ids[some]]
            sums = [np.zeros((n, vec.shape[1])) for _ in range(2)]
            for first in range(0, n, AT_ONCE):
                a, b = np.searchsorted(at, [first, first + AT_ONCE])
                if a < b:
                    starts = np.flatnonzero(np.diff(at[a:b], prepend=-1))
                    each = vec[held[a:b]].astype(np.float64)
                    sums[1][at[a:b][starts]] = np.add.reduceat(each, starts, axis=0)
                    sums[0][at[a:b][starts]] = np.add.reduceat(each * weight[a:b, None], starts, axis=0)
            totals = np.bincount(at, weight, n), np.bincount(at, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(vectors_of, sums, totals), pa.array(np.bincount(at, weight**2, n).astype(np.float64)), listed(hit[codes], n, rows, codes, tf, own), listed(~some, n, rows, codes, tf, own)],
                ["doc_id", "by_idf", "plain", "squares", "hits", "rare"],
            )

    pair = "array<struct<term:string,tf:bigint>>"
    return arrow_map(words.select("doc_id", "words"), run, f"doc_id long, by_idf array<double>, plain array<double>, squares double, hits {pair}, rare {pair}")


def corpus_scores(sums: DataFrame, counts: DataFrame, model: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """``method_scores`` from ``document_sums`` of the same: postings meet no vectors and no other postings, only rare words their df."""
    idf = counts.select(F.col("word").alias("term"), "df", F.log10(F.lit(n_docs) / F.col("df")).alias("idf"))
    few = idf.join(F.broadcast(queries.select("term").distinct()), "term")
    asked = query_weights(queries, F.broadcast(few), n_docs)
    held = asked.join(F.broadcast(model.join(F.broadcast(queries.select(F.col("term").alias("word")).distinct()), "word")), F.col("term") == F.col("word"))
    by_term = asked.groupBy("query_id", "term").agg((F.sum("weight") * F.first("idf")).alias("q"))
    each = by_term.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "q"))).alias("q"))
    for column, weight in (("q_by_idf", F.col("weight")), ("q_plain", F.lit(1.0))):
        each = each.join(vectors.mean_vectors(held.withColumn("weight", weight), "query_id").withColumnRenamed("vec", column), "query_id", "left")
    each = each.join(asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("query_size")), "query_id")

    rare = sums.select("doc_id", F.explode("rare").alias("r")).select("doc_id", F.col("r.term").alias("term"), F.col("r.tf").alias("tf"))
    more = rare.join(idf, "term").groupBy("doc_id").agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("more"))
    docs = sums.drop("rare").join(more, "doc_id", "left").withColumn("size", F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0))))

    pairs = docs.crossJoin(F.broadcast(each))  # a row for each query of an evaluation
    of = lambda h: F.try_element_at("q", h["term"])
    dot = F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["tf"] * F.coalesce(of(h), F.lit(0.0)))
    met = F.exists("hits", lambda h: of(h).isNotNull()) & (F.col("size") * F.col("query_size") > 0) & F.col("doc_id").isNotNull()
    near = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), vectors.cosine(F.col(a), F.col(b)))
    scored = pairs.select("query_id", "doc_id", F.when(met, dot / F.col("size") / F.col("query_size")).alias("a"), near("by_idf", "q_by_idf").alias("b"), near("plain", "q_plain").alias("c"))
    zero = F.lit(0.0)
    hybrid = F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), 0.5 * F.coalesce("a", zero) + 0.5 * F.coalesce("b", zero))
    parts = zip(METHODS, (F.when(F.col("a") > 0, F.col("a")), F.col("b"), F.col("c"), hybrid), strict=True)
    rows = scored.select("query_id", "doc_id", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in parts])))
    return rows.where("score is not null").select("query_id", "method", "doc_id", "score")


def evaluate(found: DataFrame, stories: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(level, method, type, topic, measures): means over all queries, by type and by topic, of ``queries(query_id, type, topic)``."""
    from . import evaluation

    qrels = evaluation.topic_relevance(stories.select(F.col("id").cast("long").alias("doc_id"), "topics"), queries)
    per = evaluation.metrics(found, qrels, k, "method")
    return evaluation.means_by_level(per.join(F.broadcast(queries.select("query_id", "type", "topic")), "query_id"))  # queries are typed by people


def rankings(scores: DataFrame) -> DataFrame:
    return ranking.ranked(scores, "query_id", "method", positive=False)


def diagnostics(queries: DataFrame, index: DataFrame, words: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, term, in_collection, df, idf, has_vector)."""
    known = query_weights(queries, _idf(index, n_docs), n_docs).join(words.select(F.col("word").alias("term"), F.lit(True).alias("has")), "term", "left")
    return known.select("query_id", "term", F.col("df").isNotNull().alias("in_collection"), F.coalesce("df", F.lit(0)).alias("df"), "idf", F.coalesce("has", F.lit(False)).alias("has_vector"))


def topic_overview(stories: DataFrame) -> DataFrame:
    """(topic, n): stories of each topic, and under null those without one."""
    return stories.select(F.explode_outer("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def split_comparison(results: DataFrame, metric: str = "ndcg") -> DataFrame:
    """Methods as rows, splits as columns, of ``results(split, method, metric)``."""
    return results.groupBy("method").pivot("split").agg(F.first(metric))


def result_rows(found: DataFrame, stories: DataFrame, topic: str, k: int = 10) -> DataFrame:
    """The first ``k`` of each method with titles and whether they have the topic; texts join after the cut."""
    first = found.where(F.col("rank") <= k)
    shown = stories.select(F.col("id").cast("long").alias("doc_id"), "title", F.array_contains("topics", topic).alias("relevant"))
    return first.join(shown, "doc_id")


def training_stats(sentences: DataFrame, top: int = 15) -> DataFrame:
    """One row of ``sentences(doc_id, words)``: documents, sentences, tokens, vocabulary and the most frequent words."""
    words = sentences.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    best = words.orderBy(F.desc("n"), "word").limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), lambda x: x["word"]).alias("top_words"))
    counts = sentences.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_sentences"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n_tokens"))
    return counts.crossJoin(F.broadcast(words.agg(F.count("*").alias("vocabulary")))).crossJoin(F.broadcast(best))


def parameter_study(sentences: DataFrame, settings: list[dict], seeds: DataFrame, k: int = 5) -> DataFrame:
    """(setting, seed, rank, word, similarity): a model for each setting of ``vectors.skip_gram``, and its neighbours."""
    parts = [vectors.neighbours(vectors.skip_gram(sentences, **s), seeds, k).withColumn("setting", F.lit(str(s))) for s in settings]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rare_words(index: DataFrame, words: DataFrame, most: int = 5, limit: int = 20) -> DataFrame:
    """(word, cf, df): words of a model that the corpus has ``most`` times at most, the rarest first."""
    stats = term_stats(index).where(F.col("cf") <= most).select(F.col("term").alias("word"), "cf", "df")
    return stats.join(words.select("word"), "word", "left_semi").orderBy("cf", "word").limit(limit)


def best_region(regions: DataFrame) -> DataFrame:
    """(condition, region): the region that follows the global fit best, among those with two words or more."""
    return regions.where("n >= 2").groupBy("condition").agg(F.min_by("region", F.struct("global_rmse", "region")).alias("region"))


def vocabulary_reduction(totals: DataFrame) -> DataFrame:
    """Per cent of the vocabulary that stemming takes away, from totals of conditions C and D."""
    wide = totals.groupBy().pivot("condition", ["C", "D"]).agg(F.first("vocabulary"))
    return wide.select(F.when(F.col("C") > 0, 100 * (F.col("C") - F.col("D")) / F.col("C")).otherwise(0.0).alias("reduction"))

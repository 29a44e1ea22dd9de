"""Ranked retrieval: vector space, BM25 in a scope, exact terms, and rankings as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import natural_bm25_idf, term_stats
from .weighting import B, K1, METHODS, document_weights, norms, query_weights, with_stats

#: Scores are ranked as rounded: engines add in different orders.
DIGITS = 10
#: Words of all queries that are ranked at once; they are broadcast.
MOST_TERMS = 100_000


def ranked(scores: DataFrame, *keys: str, limit: int | None = None, positive: bool = True) -> DataFrame:
    """``scores(doc_id, score, keys)`` with ``rank``: best first, then by doc_id; a limit becomes a limit within groups."""
    scores = scores.withColumn("score", F.round("score", DIGITS))
    if positive:
        scores = scores.where("score > 0")
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    out = scores.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "doc_id")))
    return out.where(F.col("rank") <= limit) if limit else out


def top(scores: DataFrame, limit: int, positive: bool = True) -> DataFrame:
    """The best ``limit`` of one ranking, by a distributed top-k."""
    scores = scores.withColumn("score", F.round("score", DIGITS))
    return (scores.where("score > 0") if positive else scores).orderBy(F.desc("score"), "doc_id").limit(limit)


def vector_scores(index: DataFrame, queries: DataFrame, methods: tuple[str, ...] = METHODS, cosine: bool = False) -> DataFrame:
    """(query_id, method, doc_id, score, matched) of ``queries(query_id, term, tf)``, by dot product or cosine."""
    if queries.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} words of queries at once")
    words = F.broadcast(queries.select("term").distinct().withColumn("asked", F.lit(True)))  # queries are typed by people
    asked = query_weights(queries, term_stats(index), methods)
    wanted = F.broadcast(asked.withColumnRenamed("weight", "query_weight"))
    hits = index.join(words, "term", "left_semi")
    added = F.sum(F.col("weight") * F.col("query_weight")).alias("dot"), F.collect_list("term").alias("matched")
    if cosine:
        # one pass over all words of the documents that are hit: their norms, and their weights for words of queries
        held = document_weights(with_stats(index, index.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")), methods).join(words, "term", "left")
        found = F.collect_list(F.when(F.col("asked"), F.struct("term", "weight"))).alias("found")
        sized = held.groupBy("doc_id", "method").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), found)
        each = sized.select("doc_id", "method", "norm", F.inline("found")).join(wanted, ["term", "method"])
        total = each.groupBy("query_id", "method", "doc_id").agg(*added, F.max("norm").alias("norm"))
        both = total.join(F.broadcast(norms(asked, "query_id", "method").withColumnRenamed("norm", "query_norm")), ["query_id", "method"])
        size = F.col("norm") * F.col("query_norm")
        scored = both.withColumn("score", F.when(size > 0, F.col("dot") / size).otherwise(F.lit(0.0)))
    else:
        scored = document_weights(with_stats(index, hits), methods).join(wanted, ["term", "method"]).groupBy("query_id", "method", "doc_id").agg(*added).withColumnRenamed("dot", "score")
    return scored.select("query_id", "method", "doc_id", "score", F.array_sort("matched").alias("matched"))


def unknown_terms(queries: DataFrame, index: DataFrame) -> DataFrame:
    return queries.join(index.select("term"), "term", "left_anti")


def bm25_scores(index: DataFrame, lengths: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, score, matched): BM25 with natural logarithms over one scope.

    ``lengths(doc_id, length)`` has every document of the scope, those without a token too; ``groups(term, group)`` has
    the query's terms and their variants, one contribution for each group.
    """
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    hits = index.join(F.broadcast(groups), "term").groupBy("doc_id", "group").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("group").agg(F.count("*").alias("df"))
    rich = hits.join(F.broadcast(df), "group").join(lengths, "doc_id").crossJoin(F.broadcast(stats))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    weight = natural_bm25_idf(F.col("n_docs"), F.col("df")) * part
    return rich.groupBy("doc_id").agg(F.sum(weight).alias("score"), F.array_sort(F.collect_list("group")).alias("matched"))


def all_terms_scores(index: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score) of documents that have every term: all occurrences. For queries of stop-words only."""
    hits = index.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n"), F.sum("tf").cast("double").alias("score"))
    return hits.where(F.col("n") == len(set(terms))).select("doc_id", "score")


def by_title(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """``scores(doc_id, score)`` with the titles of ``docs(doc_id, title)``: best first, equal ones by title."""
    return scores.join(docs.select("doc_id", "title"), "doc_id").orderBy(F.desc("score"), F.lower("title"), "doc_id")


def other_ranks(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """(side, query_id, doc_id, rank, other_rank): the first ``k`` of each of two rankings with their rank in the other; null if it lacks them."""
    out = None
    for side, own, other in (("first", first, second), ("second", second, first)):
        there = other.select("query_id", "doc_id", F.col("rank").alias("other_rank"))
        part = own.where(F.col("rank") <= k).join(there, ["query_id", "doc_id"], "left").select(F.lit(side).alias("side"), "query_id", "doc_id", "rank", "other_rank")
        out = part if out is None else out.unionByName(part)
    return out


def variant_groups_of(queries: list[str], terms: DataFrame) -> DataFrame:
    """groups(term, group) for ``bm25_scores``: each word of a query with its variants among ``terms(term)``."""
    from .fuzzy import expand

    asked = terms.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(queries)], "term string")
    return expand(asked, terms).select("term", "group")


def variants_present(groups: DataFrame, index: DataFrame) -> DataFrame:
    """(group, variants): which other forms of a query's words a scope has, for words that have any."""
    there = groups.where("term <> group").join(index.select("term").distinct(), "term", "left_semi")
    return there.groupBy("group").agg(F.array_sort(F.collect_set("term")).alias("variants"))


def exact_term_documents(condition_postings: DataFrame, term: str) -> DataFrame:
    return condition_postings.where(F.col("term") == term).orderBy(F.desc("tf"), "doc_id")


def rank_of(rankings: DataFrame, doc_id: int) -> DataFrame:
    return rankings.where(F.col("doc_id") == doc_id)


def rank_change(rankings: DataFrame, baseline: str) -> DataFrame:
    """Each ranking's rows with their rank in the baseline method and the change against it; null where it lacks the document."""
    base = rankings.where(F.col("method") == baseline).select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    return rankings.join(base, ["query_id", "doc_id"], "left").withColumn("change", F.col("base_rank") - F.col("rank"))


def top_overlap(rankings: DataFrame, baseline: str, k: int = 10) -> DataFrame:
    """(method, query_id, overlap): documents of the first ``k`` that the baseline has there, too."""
    first = rankings.where(F.col("rank") <= k)
    base = first.where(F.col("method") == baseline).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return first.join(base, ["query_id", "doc_id"], "left").groupBy("method", "query_id").agg(F.count("hit").alias("overlap"))


def term_documents(index: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """(doc_id, tf, log_tf, tfidf) of the documents that use a term most."""
    rich = index.join(term_stats(index).where(F.col("term") == term), "term")
    best = rich.orderBy(F.desc("tf"), "doc_id").limit(limit)
    return best.select("doc_id", "tf", (1 + F.log10("tf")).alias("log_tf"), (F.col("tf") * F.col("idf")).alias("tfidf"), "df", "cf", "idf")


def document_terms(index: DataFrame, limit: int = 10) -> DataFrame:
    """(doc_id, rank, term, tfidf): the terms that stand out in each document."""
    weighted = index.join(term_stats(index).select("term", "idf"), "term").withColumn("tfidf", F.round(F.col("tf") * F.col("idf"), DIGITS))
    order = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), "term")
    return weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("doc_id", "rank", "term", "tfidf")


def tfidf_of_term(index: DataFrame, term: str) -> DataFrame:
    weighted = index.join(term_stats(index).where(F.col("term") == term), "term")
    return weighted.select("doc_id", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def extreme_terms(index: DataFrame, limit: int = 20, highest: bool = True, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """Terms by document frequency, then collection frequency."""
    stats = term_stats(index).where(F.col("df") >= min_df)
    if max_df is not None:
        stats = stats.where(F.col("df") <= max_df)
    return stats.orderBy(F.desc("df") if highest else F.asc("df"), F.desc("cf"), "term").limit(limit)


def page(rows: DataFrame, *order: Column | str, number: int = 1, size: int = 20) -> DataFrame:
    """One page; a number beyond the last page gives the last."""
    total = rows.count()
    number = min(max(1, number), max(1, -(-total // size)))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def hybrid(first: DataFrame, second: DataFrame, weight: float = 0.5) -> DataFrame:
    """(doc_id, score): a weighted sum; a document that one side lacks scores 0 there."""
    a, b = first.select("doc_id", F.col("score").alias("a")), second.select("doc_id", F.col("score").alias("b"))
    zero = F.lit(0.0)
    return a.join(b, "doc_id", "full_outer").select("doc_id", (weight * F.coalesce("a", zero) + (1 - weight) * F.coalesce("b", zero)).alias("score"))

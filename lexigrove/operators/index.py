"""The postings relation and the statistics that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_terms
from ..functions.text import tokens, weighting_tokens, without_stop_words


def postings(docs: DataFrame, words: Column, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf) of each document: one explode, one pre-aggregated shuffle."""
    exploded = docs.select(F.col(id_column).alias("doc_id"), F.explode(words).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def stemmed_postings(docs: DataFrame, words: Column) -> DataFrame:
    """Postings of stems: words are counted first, distinct ones stemmed, counts added."""
    stems = stem_terms(postings(docs, words))
    return stems.groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def search_postings(docs: DataFrame) -> DataFrame:
    """What the search index holds: words without stop-words, stemmed."""
    return stemmed_postings(docs, without_stop_words(tokens(F.col("text"))))


def weighting_postings(docs: DataFrame, stop_words: bool = True, stem: bool = False) -> DataFrame:
    """What the weighting laboratory counts: words with one kind of hyphen, with or without stop-words, as they are or stemmed."""
    words = weighting_tokens(F.col("text"), stop_words)
    return stemmed_postings(docs, words) if stem else postings(docs, words)


def stored_postings(docs: DataFrame, words: Column, width: int = 100) -> DataFrame:
    """Postings as they are written: terms cut to ``width`` characters."""
    return postings(docs, F.transform(words, lambda t: F.substring(t, 1, width)))


def doc_lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count("*").alias("n_terms"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: documents with a token, their tokens and mean length."""
    return doc_lengths(index).agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_tokens"), F.avg("length").alias("avg_length"))


def idf(n_docs: Column, df: Column) -> Column:
    """log10(N / df), 0 where the term occurs nowhere."""
    return F.when(df > 0, F.log10(n_docs / df)).otherwise(F.lit(0.0))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log10((n_docs - df + 0.5) / (df + 0.5) + 1)


def natural_bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def term_stats(index: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(term, df, cf, idf, bm25_idf)."""
    counts = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = (stats if stats is not None else corpus_stats(index)).select("n_docs")
    joined = counts.crossJoin(F.broadcast(n))  # one row
    return joined.select("term", "df", "cf", idf(F.col("n_docs"), F.col("df")).alias("idf"), bm25_idf(F.col("n_docs"), F.col("df")).alias("bm25_idf"))


def corpus_summary(index: DataFrame) -> DataFrame:
    """One row: documents, tokens, vocabulary, hapax, and the lengths' mean, median and range."""
    lengths = doc_lengths(index).agg(
        F.count("*").alias("n_docs"),
        F.sum("length").alias("n_tokens"),
        F.avg("length").alias("avg_length"),
        F.percentile("length", F.lit(0.5)).alias("median_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
    )
    words = index.groupBy("term").agg(F.sum("tf").alias("cf")).agg(F.count("*").alias("vocabulary"), F.count_if(F.col("cf") == 1).alias("hapax"))
    return lengths.crossJoin(F.broadcast(words))


def length_histogram(index: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, high, n_docs): equal widths, the last bin closed."""
    lengths = doc_lengths(index)
    span = lengths.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    placed = lengths.crossJoin(F.broadcast(span)).withColumn(
        "bin", F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("length") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))).cast("int")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda k: F.floor(F.col("lo") + width * k).cast("long")
    return placed.groupBy("bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high")).agg(F.count("*").alias("n_docs"))


def orphan_terms(vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """Terms of ``vocabulary`` that no posting has."""
    return vocabulary.join(index.select("term"), "term", "left_anti")


def unindexed(docs: DataFrame, index: DataFrame) -> DataFrame:
    return docs.join(index.select("doc_id"), "doc_id", "left_anti")


def replace_documents(index: DataFrame, new: DataFrame) -> DataFrame:
    """``index`` with the postings of the documents that ``new`` has replaced by its own."""
    return index.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def delete_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("doc_id"), "doc_id", "left_anti")

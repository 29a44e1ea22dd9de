"""Term weights of documents and queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import corpus_stats, doc_lengths, term_stats

#: Fixed values.
K1, B = 1.2, 0.75


def _log_tf() -> Column:
    return 1 + F.log10("tf")


def _saturated(idf: str) -> Column:
    return F.col(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))


#: Method: weight of a posting in a document, of columns tf, idf, bm25_idf, length, avg_length.
DOCUMENT: dict[str, Callable[[], Column]] = {
    "raw_tf": lambda: F.col("tf").cast("double"),
    "log_tf": _log_tf,
    "idf": lambda: F.col("idf"),
    "tfidf": lambda: F.col("tf") * F.col("idf"),
    "logtfidf": lambda: _log_tf() * F.col("idf"),
    "bm25": lambda: _saturated("bm25_idf"),
}
#: Method: weight of a term in a query, of columns tf and idf.
QUERY: dict[str, Callable[[], Column]] = DOCUMENT | {"bm25": DOCUMENT["raw_tf"]}
METHODS = tuple(DOCUMENT)


def with_stats(index: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Postings (or some ``rows`` of them) with what the weights need: term, document and corpus statistics of all."""
    stats = corpus_stats(index)
    lengths = doc_lengths(index).select("doc_id", "length")
    return (index if rows is None else rows).join(term_stats(index, stats), "term").join(lengths, "doc_id").crossJoin(F.broadcast(stats.select("n_docs", "avg_length")))


def document_weights(rich: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(doc_id, term, method, weight): all methods from one pass over postings."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), DOCUMENT[m]().alias("weight")) for m in methods])
    return rich.select("doc_id", "term", F.explode(pairs).alias("x")).select("doc_id", "term", "x.method", "x.weight")


def query_weights(queries: DataFrame, terms: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(query_id, term, method, weight) of ``queries(query_id, term, tf)``; terms that are in no document are left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), QUERY[m]().alias("weight")) for m in methods])
    known = terms.join(F.broadcast(queries), "term")  # queries are typed by people
    return known.select("query_id", "term", F.explode(pairs).alias("x")).select("query_id", "term", "x.method", "x.weight")


def norms(weights: DataFrame, *keys: str) -> DataFrame:
    return weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))

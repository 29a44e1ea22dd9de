"""What pages and exports are made of: details of one document, tables by topic, bundles of tables, the index as written, kept models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import match
from ..functions import sentences as sent
from ..functions import text as tx
from ..sources.tables import export_tables, write_csv, write_vectors
from . import evaluation, index, ranking, scope, vectors, zipf


def display_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, words, characters, sentences) as lists show them."""
    t = F.col(column)
    return docs.select("doc_id", F.size(tx.tokens(t)).cast("long").alias("words"), tx.char_count(t).cast("long").alias("characters"), sent.sentence_count(t).cast("long").alias("sentences"))


def document_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, characters, characters_no_space, words, sentences, words_per_sentence) of each document."""
    t = F.col(column)
    rows = docs.select("doc_id", tx.char_count(t).cast("long").alias("characters"), tx.char_count_no_space(t).cast("long").alias("characters_no_space"), F.size(tx.tokens(t)).cast("long").alias("words"), sent.sentence_count(t).cast("long").alias("sentences"))
    return rows.withColumn("words_per_sentence", F.when(F.col("sentences") > 0, F.round(F.col("words") / F.col("sentences"), 2)).otherwise(0.0))


def reading_view(docs: DataFrame, column: str = "raw_text") -> DataFrame:
    """(doc_id, block, kind, number, sentence): full texts in blocks parted by empty lines, sentences numbered through a document.

    A block of one line that no sentence's end closes is a section's title; its text has no number.
    """
    blocks = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\r?\n\s*\n"), F.trim), lambda b: b != "")).alias("block", "text"))
    title = ~F.col("text").rlike(r"[.!?。！？:;]\W*$") & ~F.col("text").contains("\n") & (F.length("text") <= 120)
    rows = blocks.withColumn("kind", F.when(title, "section").otherwise("paragraph")).withColumn("s", F.when(title, F.array("text")).otherwise(sent.sentences(tx.collapse(F.col("text")))))
    counted = rows.withColumn("n", F.when(F.col("kind") == "paragraph", F.size("s")).otherwise(0))
    order = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("doc_id", "block", "kind", "before", F.posexplode("s").alias("at", "sentence"))
    return placed.select("doc_id", "block", "kind", F.when(F.col("kind") == "paragraph", F.col("before") + F.col("at") + 1).alias("number"), "sentence")


def article_detail(docs: DataFrame, doc_id: int, wanted: match.Wanted) -> DataFrame:
    """(doc_id, place, sentence, matches) of one article: its sentences as HTML, matches numbered through the whole article."""
    one = docs.where(F.col("doc_id") == doc_id).select("doc_id", sent.sentences(F.col("text")).alias("s"))
    counts = F.transform("s", lambda x: match.match_count(x, wanted))
    before = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0), lambda a, x: a + x))
    placed = one.where(F.size("s") > 0).withColumn("counts", counts).withColumn("before", before)
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("s", "counts", "before")).alias("place", "x"))
    return rows.select("doc_id", "place", match.highlight(F.col("x.s"), wanted, first=F.col("x.before")).alias("sentence"), F.col("x.counts").alias("matches"))


def story_detail(stories: DataFrame, rankings: DataFrame, words: DataFrame, story: int, topic: str, top: int = 10) -> DataFrame:
    """One row of a story: its splits, whether it has the topic, its rank by method, and the terms that stand out."""
    one = stories.where(F.col("id") == story)
    base = one.select("id", "title", "splits", F.array_contains("topics", topic).alias("relevant"))
    ranks = ranking.rank_of(rankings, story).groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "rank")))).alias("ranks"))
    terms = ranking.document_terms(words, top).where(F.col("doc_id") == story).groupBy(F.col("doc_id").alias("id"))
    return base.join(ranks, "id", "left").join(terms.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms")), "id", "left")


def queries_by_topic(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, queries, keywords) of ``queries(query_id, topic, text)`` and ``keywords(topic, rank, term)``."""
    asked = queries.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("query_id", "text"))).alias("queries"))
    words = keywords.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    return asked.join(words, "topic", "left")


def hits_at(found: DataFrame) -> DataFrame:
    """(method, hits) of ``result_rows``: how many of the rows shown are relevant."""
    return found.groupBy("method").agg(F.count_if("relevant").alias("hits"))


# --- the index as written -------------------------------------------------------------------------------------------------


def write_index(docs: DataFrame, words: Column, path: str, replace: DataFrame | None = None) -> None:
    """(Re)build the postings below ``path``; documents keep their ids. With ``replace(doc_id)`` only these documents' postings change.

    A part is written beside the old one and takes its place at the end.
    """
    spark = docs.sparkSession
    made = index.stored_postings(docs if replace is None else docs.join(replace.select("doc_id").distinct(), "doc_id", "left_semi"), words)
    if replace is not None:
        made = index.delete_documents(spark.read.parquet(path), replace.select("doc_id").distinct()).unionByName(made)
    made.write.mode("overwrite").parquet(f"{path}.new")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    files = old.getFileSystem(conf)
    files.delete(old, True)
    files.rename(new, old)


def delete_cascade(gone: DataFrame, docs: DataFrame, links: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, postings) without the documents ``gone(doc_id)``."""
    ids = gone.select("doc_id").distinct()
    return tuple(t.join(ids, "doc_id", "left_anti") for t in (docs, links, words))


# --- bundles --------------------------------------------------------------------------------------------------------------


def zipf_bundle(table: DataFrame, n_docs: int, docs: DataFrame, settings: dict) -> dict[str, DataFrame]:
    """Tables of a rank-frequency export: summary, terms by condition, regions, the corpus, and how it was done."""
    spark = table.sparkSession
    summary = zipf.totals(table, n_docs).join(zipf.fit(table, "condition"), "condition")
    method = spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(settings.items())], "setting string, value string")
    return {"summary": summary, "terms": table, "regions": zipf.regions(table), "corpus": docs.select("doc_id"), "methodology": method}


def domain_bundle(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a comparison of domains, from the term table of each: totals, fits, and the share of common top terms."""
    both = None
    for name, t in tables.items():
        part = t.withColumn("domain", F.lit(name))
        both = part if both is None else both.unionByName(part)
    totals = both.groupBy("domain", "condition").agg(F.sum("cf").alias("tokens"), F.count("*").alias("vocabulary"), F.count_if(F.col("cf") == 1).alias("hapax"))
    tops = both.where("rank <= 10").groupBy("condition", "domain").agg(F.collect_set("term").alias("top"))
    pairs = tops.alias("a").join(tops.alias("b"), (F.col("a.condition") == F.col("b.condition")) & (F.col("a.domain") < F.col("b.domain")))
    overlap = pairs.select("a.condition", F.col("a.domain").alias("first"), F.col("b.domain").alias("second"), scope.jaccard(F.col("a.top"), F.col("b.top")).alias("jaccard"))
    return {"terms": both, "totals": totals, "fits": zipf.fit(both, "domain", "condition"), "overlap": overlap}


def report_bundle(words: DataFrame, evaluations: DataFrame) -> dict[str, DataFrame]:
    """Tables of the research report: summary, terms, all TF-IDF weights, evaluation with means."""
    weights = words.join(index.term_stats(words).select("term", "idf"), "term").select("doc_id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))
    return {"summary": index.corpus_summary(words), "terms": index.term_stats(words), "tfidf": weights, "evaluation": evaluation.with_means(evaluations, "method")}


def experiment_bundle(per_query: DataFrame, rankings: DataFrame, qrels: DataFrame) -> dict[str, DataFrame]:
    """Everything of an experiment: measures by query, means, comparisons with the first method, rankings and judgments."""
    return {"per_query": per_query, "means": evaluation.means(per_query, "method"), "best": evaluation.best_flags(evaluation.means(per_query, "method")), "rankings": rankings.where("rank <= 100"), "qrels": qrels}


def write_model_bundle(words: DataFrame, tables: dict[str, DataFrame], folder: str) -> None:
    """A model as text vectors, and tables about it (losses, neighbours, pairs, rare words, corpus ids)."""
    write_vectors(words, f"{folder}/vectors.txt")
    export_tables(tables, folder)


def write_evaluation(per_query: DataFrame, path: str) -> None:
    """Measures by query with rows of means, four digits."""
    write_csv(evaluation.with_means(per_query, "method"), path, digits=4)


# --- settings and kept models ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """What a model of words is trained with; values outside their range are refused."""

    architecture: str = "skipgram"
    condition: str = "B"
    size: int = 100
    window: int = 5
    min_count: int = 5
    epochs: int = 5
    seed: int = 42

    def __post_init__(self):
        if self.architecture not in ("skipgram", "cbow") or self.condition not in tx.CONDITIONS:
            raise ValueError(f"{self.architecture} under condition {self.condition} can't be trained")
        for name, low, high in (("size", 2, 1000), ("window", 1, 20), ("min_count", 1, 1000), ("epochs", 1, 200)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")

    def key(self, corpus: str) -> str:
        """A name for the model of a corpus with that hash."""
        return hashlib.sha256(json.dumps(asdict(self) | {"corpus": corpus}, sort_keys=True).encode()).hexdigest()[:24]


class ModelStore:
    """Models below a folder, by a hash of their corpus and settings: trained once, then read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _there(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def get(self, docs: DataFrame, settings: Settings, train: Callable[[DataFrame, Settings], DataFrame]) -> tuple[DataFrame, bool]:
        """(the model's vectors, whether they were there) for ``docs(doc_id, text)``."""
        path = f"{self.folder}/{settings.key(scope.tree_hash(docs).first()[0] or '')}"
        there = self._there(path)
        if not there:
            train(docs, settings).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), there


def train_model(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word, vec): skip-gram where the sentences are; CBOW, which has no distributed form, in one task."""
    if settings.condition == "D":
        raise ValueError("models are trained under conditions A to C")
    rows = docs.select(F.explode(sent.condition_sentences(F.col("text"), settings.condition)).alias("words"))
    if settings.architecture == "skipgram":
        return vectors.skip_gram(rows, settings.size, settings.window, settings.min_count, settings.epochs, settings.seed)
    how = vectors.Network("cbow", settings.size, settings.window, settings.epochs, negatives=5, batch=64, seed=settings.seed)
    return vectors.train_groups(rows.select(F.lit("cbow").alias("model"), "words"), how).select("word", "vec")


def ablation(sentence_sets: dict[str, DataFrame], evaluate: Callable[[DataFrame], DataFrame], settings: Settings) -> DataFrame:
    """(corpus, and what ``evaluate`` gives for a model) for each set of sentences: how results depend on the corpus's size."""
    out = None
    for name, rows in sentence_sets.items():
        model = vectors.skip_gram(rows, settings.size, settings.window, settings.min_count, settings.epochs, settings.seed)
        part = evaluate(model).withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

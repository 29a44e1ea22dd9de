"""Relevance and retrieval metrics as joins and aggregates over rankings and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_grades(headings: DataFrame, rules: DataFrame) -> DataFrame:
    """qrels(query_id, doc_id, grade): 2 where a major heading fits a query's rule, 1 where another does.

    ``headings(doc_id, descriptor, major, qualifiers)``; ``rules(query_id, kind, value)`` with kind descriptor or qualifier.
    """
    small = F.broadcast(rules)  # written by people
    by_name = headings.join(small.where("kind = 'descriptor'"), headings.descriptor == F.col("value"))
    each = headings.withColumn("qualifier", F.explode("qualifiers"))
    by_qualifier = each.join(small.where("kind = 'qualifier'"), each.qualifier == F.col("value"))
    grade = F.when(F.col("major"), 2).otherwise(1)
    both = by_name.select("query_id", "doc_id", grade.alias("grade")).union(by_qualifier.select("query_id", "doc_id", grade.alias("grade")))
    return both.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def topic_relevance(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qrels of ``docs(doc_id, topics)``: 1 where a query's topic is among a document's."""
    return docs.select("doc_id", F.explode("topics").alias("topic")).distinct().join(F.broadcast(queries.select("query_id", "topic")), "topic").select("query_id", "doc_id", F.lit(1).alias("grade"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ideal_dcg(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, idcg, n_relevant): over all judged documents, whatever was retrieved."""
    good = qrels.where("grade > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    placed = good.withColumn("place", F.row_number().over(order))
    return placed.groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("idcg"),
        F.count("*").alias("n_relevant"),
        F.count_if(F.col("grade") >= 2).alias("n_highly_relevant"),
    )


def metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10, *keys: str) -> DataFrame:
    """(query_id, keys, p5, p, recall, rr, ndcg) of full rankings (query_id, keys, doc_id, rank).

    Precision divides by k even if fewer were retrieved; the reciprocal rank looks at the whole ranking.
    """
    judged = rankings.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = F.col("grade") > 0
    within = lambda n: F.col("rank") <= n
    found = judged.groupBy("query_id", *keys).agg(
        (F.count_if(hit & within(5)) / 5).alias("p5"),
        (F.count_if(hit & within(k)) / k).alias("p"),
        F.count_if(hit & within(k)).alias("hits"),
        F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(within(k), _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.broadcast(ideal_dcg(qrels, k))  # a row for each query
    joined = found.join(ideal, "query_id", "left")
    return joined.select(
        "query_id",
        *keys,
        "p5",
        "p",
        F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(F.lit(0.0)).alias("recall"),
        "rr",
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"),
    )


METRICS = ("p5", "p", "recall", "rr", "ndcg")


def means(per_query: DataFrame, *keys: str) -> DataFrame:
    return per_query.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def means_by_level(per_query: DataFrame) -> DataFrame:
    """Means of ``per_query(method, type, topic, metrics)``: over all queries, by type, and by topic, in one pass."""
    sets = [[F.col("method")], [F.col("method"), F.col("type")], [F.col("method"), F.col("topic")]]
    grouped = per_query.groupingSets(sets, "method", "type", "topic")
    level = F.when(F.grouping("type") == 0, F.lit("type")).when(F.grouping("topic") == 0, F.lit("topic")).otherwise(F.lit("all"))
    return grouped.agg(level.alias("level"), *[F.avg(m).alias(m) for m in METRICS])


def with_means(per_query: DataFrame, *keys: str) -> DataFrame:
    """Rows of each query and, under the id MEAN, of their means."""
    mean = means(per_query, *keys).withColumn("query_id", F.lit("MEAN"))
    return per_query.withColumn("query_id", F.col("query_id").cast("string")).unionByName(mean)


def best_flags(rows: DataFrame) -> DataFrame:
    """For each metric whether a row has its best value."""
    everything = Window.partitionBy(F.lit(0))
    return rows.withColumns({f"{m}_best": F.col(m) == F.max(m).over(everything) for m in METRICS})


def compare_methods(per_query: DataFrame, first: str, second: str, metric: str = "ndcg") -> DataFrame:
    """(query_id, first, second, delta) of one metric."""
    wide = per_query.groupBy("query_id").pivot("method", [first, second]).agg(F.first(metric))
    return wide.withColumn("delta", F.col(second) - F.col(first))


def scaled(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """``value`` scaled to 0..1 within its group; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.lit(0.0)))

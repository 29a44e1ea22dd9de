"""Scopes, facets, samples and set operations over documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, is_blank, sample_key, topic_key


def in_topics(docs: DataFrame, bridge: DataFrame, topics: list[int], year: str | None = None) -> DataFrame:
    """Documents of any of the topics (all if none is chosen), each once."""
    out = docs
    if topics:
        out = out.join(bridge.where(F.col("topic_id").isin(topics)).select("doc_id"), "doc_id", "left_semi")
    return out.where(F.col("publication_year") == year) if year else out


def topic_counts(topics: DataFrame, bridge: DataFrame) -> DataFrame:
    counts = bridge.groupBy("topic_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return topics.join(counts, "topic_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).orderBy("name")


def corpus_scope(docs: DataFrame) -> DataFrame:
    """Documents with an abstract and a PubMed id that are not preprints."""
    return docs.where("abstract <> '' AND pmid <> '' AND coalesce(arxiv_id, '') = ''")


def not_blank(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.where(~is_blank(F.col(column)))


def domain(arxiv_id: Column) -> Column:
    return F.when(F.coalesce(F.length(arxiv_id), F.lit(0)) > 0, "cs").otherwise("medical")


def term_contains(table: DataFrame, part: str) -> DataFrame:
    return table.where(F.col("term").contains(part.casefold()))


def title_contains(docs: DataFrame, part: str) -> DataFrame:
    return docs.where(casefold(F.col("title")).contains(part.casefold()))


def has_topic(docs: DataFrame, topic: str | None) -> DataFrame:
    """Documents with a topic, or without any (None)."""
    return docs.where(F.size("topics") == 0 if topic is None else F.array_contains("topics", topic))


def importable(docs: DataFrame, needs_headings: bool = False) -> DataFrame:
    """Records with an abstract beyond its keyword line."""
    body = F.element_at(F.split("abstract", "\n\nKeywords:"), 1)
    out = docs.where(~is_blank(body) & ~F.col("abstract").startswith("Keywords:"))
    return out.where(F.size("headings") > 0) if needs_headings else out


def years(docs: DataFrame) -> DataFrame:
    """Distinct years: numbers from late to early, then other values."""
    found = docs.where(~is_blank(F.col("publication_year"))).select(F.trim("publication_year").alias("year")).distinct()
    number = F.expr("try_cast(CASE WHEN year RLIKE '^[0-9]+$' THEN year END AS int)")
    return found.orderBy(number.isNull(), F.desc(number), "year")


def ordered(docs: DataFrame, order: str = "az") -> DataFrame:
    """Articles by title or year."""
    title = F.lower("title")
    by = {"az": [title.asc()], "za": [title.desc()], "oldest": [F.asc("publication_year"), title.asc()], "newest": [F.desc("publication_year"), title.asc()]}
    return docs.orderBy(*by[order], "doc_id")


def lowest_ids(docs: DataFrame, group: str, cap: int | None = None, balanced: bool = True) -> DataFrame:
    """The lowest ids of each group up to the cap, and no more than the smallest group has."""
    w = Window.partitionBy(group)
    out = docs.withColumn("nth", F.row_number().over(w.orderBy("doc_id")))
    sizes = docs.groupBy(group).count().agg(F.min("count").alias("least"))
    if balanced:
        out = out.crossJoin(F.broadcast(sizes)).where(F.col("nth") <= F.col("least")).drop("least")
    return (out.where(F.col("nth") <= cap) if cap else out).drop("nth")


def hash_sample(docs: DataFrame, group: str, cap: int, seed: int = 42) -> DataFrame:
    """``cap`` documents of each group in the order of a hash of seed, group and id."""
    keyed = docs.withColumn("sample_key", sample_key(seed, F.col(group), F.col("doc_id")))
    order = Window.partitionBy(group).orderBy("sample_key")
    return keyed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap)


def content_hash(docs: DataFrame) -> DataFrame:
    """One row: SHA-256 over id, a zero, text, a zero of all documents in the order of ids, as one stream.

    The stream passes through the driver one partition of sorted rows at a time: SHA-256 has no parallel form.
    """
    digest = hashlib.sha256()
    for row in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").toLocalIterator():
        digest.update(f"{row['doc_id']}\0{row['text']}\0".encode())
    return docs.sparkSession.createDataFrame([(digest.hexdigest(),)], "content_hash string")


def tree_hash(docs: DataFrame) -> DataFrame:
    """One row: a hash over (id, text) of all documents in the order of ids, by hashes of hashes, for corpora beyond one stream."""
    each = docs.select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\u0000"), F.coalesce("text", F.lit("")), F.lit("\u0000")), 256).alias("h"))
    blocks = each.groupBy(F.floor(F.col("doc_id") / 4096).alias("block")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"])), 256).alias("h"))
    upper = blocks.groupBy(F.floor(F.col("block") / 4096).alias("part")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"])), 256).alias("h"))
    return upper.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])), 256).alias("tree_hash"))


def signature(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))


def topic_bridge(docs: DataFrame, column: str = "source") -> DataFrame:
    return docs.select("doc_id", topic_key(F.col(column)).alias("topic_key")).distinct()


def split_domains(docs: DataFrame, first: Column, second: Column, overlap: str = "exclude", cap: int | None = None) -> DataFrame:
    """(doc_id, domain) of two groups; documents of both are left out, or counted in both."""
    both = first & second
    a, b = docs.where(first & ~both if overlap == "exclude" else first), docs.where(second & ~both if overlap == "exclude" else second)
    rows = a.withColumn("domain", F.lit("a")).unionByName(b.withColumn("domain", F.lit("b")))
    return lowest_ids(rows, "domain", cap) if cap else rows


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def topic_keywords(docs: DataFrame, words: Column, topics: Column, limit: int = 10) -> DataFrame:
    """(topic, term, score, rank): share of a topic's documents with a term, less the share of all others."""
    base = docs.select(F.array_distinct(words).alias("words"), F.array_sort(F.array_distinct(topics)).alias("topics"))
    per_topic = docs.select(F.explode(F.array_distinct(topics)).alias("topic")).groupBy("topic").agg(F.count("*").alias("size"))
    total = docs.agg(F.count("*").alias("n"))
    pairs = base.select(F.explode("words").alias("term"), "topics").groupBy("term", "topics").agg(F.count("*").alias("k"))  # one pass, summed by sets of topics
    overall = pairs.groupBy("term").agg(F.sum("k").alias("df"))
    inside = pairs.select("term", "k", F.explode("topics").alias("topic")).groupBy("topic", "term").agg(F.sum("k").alias("in_df"))
    joined = inside.join(overall, "term").join(F.broadcast(per_topic), "topic").crossJoin(F.broadcast(total))
    outside = F.when(F.col("n") > F.col("size"), (F.col("df") - F.col("in_df")) / (F.col("n") - F.col("size"))).otherwise(F.lit(0.0))
    scored = joined.withColumn("score", F.round(F.col("in_df") / F.col("size") - outside, 10))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("topic", "term", "score", "rank")


#: Presets of samples: for each class how many documents, or all.
PRESETS = {"medical": {"medical": 1000}, "cs": {"cs": 1000}, "balanced": {"medical": 500, "cs": 500}, "all": {}}


def preset_sample(docs: DataFrame, preset: str, group: str = "domain", seed: int = 42, custom: dict[str, int] | None = None) -> DataFrame:
    """Documents of a preset (or ``custom`` numbers by class) in the order of a hash; balanced ones have as many of each class."""
    if preset != "custom" and preset not in PRESETS:
        raise ValueError(f"no preset {preset}; there are {', '.join(sorted(PRESETS))} and custom")
    caps = custom or {} if preset == "custom" else PRESETS[preset]
    if not caps:
        return docs
    chosen = docs.where(F.col(group).isin(list(caps)))
    if preset == "balanced":
        least = chosen.groupBy(group).count().agg(F.min("count")).first()[0] or 0
        caps = {k: min(v, least) for k, v in caps.items()}
    keyed = hash_sample(chosen, group, max(caps.values()), seed)
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(group)]
    return keyed.where(F.col("nth") <= cap).drop("nth", "sample_key")


def class_counts(docs: DataFrame, group: str = "domain") -> DataFrame:
    """(class, n) of a selection."""
    return docs.groupBy(F.col(group).alias("class")).agg(F.count("*").alias("n"))


def topics_of_documents(docs: DataFrame, bridge: DataFrame, topics: DataFrame) -> DataFrame:
    """``docs`` with ``topics``, the names of each document's topics in order; an empty list where it has none."""
    names = bridge.join(topics.select("topic_id", "name"), "topic_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("topics"))
    return docs.join(names, "doc_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))

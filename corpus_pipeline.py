"""The corpus pipeline: language ID, SimHash near-dedup, secret scans, mixing to target weights, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.llm import langid, mixing, packing, secret_scan, simhash
from lexigrove.llm.registry import MIX_BUDGET, MIX_TARGETS, VOCABULARY
from lexigrove.llm.shared import free_name, in_sketch, materialize, scratch_tables, sketch_of

#: A document is rejected if no language is this probable.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; ``lang`` is what was predicted."""
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, model, *docs.columns, names=(pred, score))
    kept = found.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(pred)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) goes on: the one with the smallest id.

    Of rows that repeat an id within a group one goes on, the first by a hash of all columns; rows without an id can't be told apart and
    all go on. Texts are shuffled only where a sketch says that a row may be dropped.
    """
    found = simhash.similar_documents(docs)
    first = found.where("doc_id = component_id")
    with scratch_tables(spark):
        repeated = materialize(first.groupBy("doc_id", "root").count().where("count > 1").select("doc_id", "root"), "repeated")
        unsure = first.join(repeated, ["doc_id", "root"]).select("doc_id", "text_hash", "root")
        others = found.where("doc_id <> component_id").select("doc_id", "text_hash", F.lit(None).cast("long").alias("root"))
        dropped = materialize(others.union(unsure).distinct(), "dropped", keep=True)
    key, group, order, likely = (free_name(docs, n) for n in ("_text_hash", "_group", "_order", "_likely"))
    keyed = docs.withColumn(key, simhash.text_hash(F.col("text")))
    flagged = in_sketch(keyed, sketch_of(dropped, "doc_id", "text_hash"), "doc_id", key, flag=likely).withColumn(likely, F.col(likely) & F.col("doc_id").isNotNull())
    asked = flagged.where(likely)
    verdict = dropped.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "root": "_root"})
    joined = asked.join(verdict.hint("merge"), (asked["doc_id"] == verdict["_id"]) & (asked[key] == verdict["_hash"]), "left")
    stay = joined.where(verdict["_id"].isNull() | verdict["_root"].isNotNull()).select(*[asked[c] for c in docs.columns], verdict["_root"].alias(group))
    stay = materialize(stay, "stay")
    first_rows = stay.where(F.col(group).isNotNull()).withColumn(order, F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(*docs.columns)))).where(F.col(order) == 1)
    parts = (flagged.where(~F.col(likely)), stay.where(F.col(group).isNull()), first_rows)
    return reduce(DataFrame.union, [p.select(*docs.columns) for p in parts])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document goes on, with its secrets masked."""
    base, entropy = free_name(docs, "base"), free_name(docs, "entropy")
    found = secret_scan.scan_secrets(docs, base, entropy)
    clean = secret_scan.redact(F.col("text"), F.array_sort(F.concat(base, entropy)))
    return found.withColumn("text", clean).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics."""
    return mixing.mix(docs, MIX_TARGETS, MIX_BUDGET).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences: one row for each piece."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("packing", pack)]

#: Fingerprints, the trained model and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Incremental corpus import: files arrive, records are parsed, known ones are linked, new ones are indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens, without_stop_words
from ..operators.index import postings
from ..sources.tables import find_duplicates
from ..sources.xml import parse_articles

DOCUMENTS = (
    "doc_id long, source_file string, title string, raw_text string, pmcid string, pmid string, arxiv_id string, doi string, "
    "journal string, publication_year string, authors string, abstract string, batch long"
)
LINKS = "doc_id long, topic string, batch long"
FILES = "path string, modificationTime timestamp, length long, content binary"


class Corpus:
    """Documents, links and postings as Parquet folders; each micro-batch writes a folder of its own, so that a repeated batch replaces itself."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if batch is None else f"/batch={batch}")

    def _read(self, table: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(self._path(table)) if there else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS)

    def links(self) -> DataFrame:
        return self._read("links", LINKS).select("doc_id", "topic").distinct()

    def postings(self) -> DataFrame:
        return self._read("postings", "doc_id long, term string, tf long, batch long")

    def add(self, files: DataFrame, batch: int, topic: str) -> dict[str, int]:
        """Parse, link or store, and index one batch; counts of added, linked and skipped records."""
        total = files.count()
        records = parse_articles(files.select("path", "content")).withColumn("incoming_id", F.xxhash64("source_file", "raw_text"))
        records = records.dropDuplicates(["incoming_id"]).cache()
        known = self.documents().where(F.col("batch") != batch)
        copies = find_duplicates(records, known).cache()
        fresh = records.join(copies, "incoming_id", "left_anti")
        inner = find_duplicates(fresh, fresh.withColumn("doc_id", F.col("incoming_id"))).where("incoming_id <> doc_id").select(F.least("incoming_id", "doc_id").alias("keep"), F.greatest("incoming_id", "doc_id").alias("incoming_id"))
        fresh = fresh.join(inner, "incoming_id", "left_anti")
        stored = fresh.withColumn("doc_id", F.col("incoming_id")).select(*[c.strip().split(" ")[0] for c in DOCUMENTS.split(", ") if "batch" not in c]).cache()
        added, linked = stored.count(), copies.count()
        stored.write.mode("overwrite").parquet(self._path("documents", batch))
        stored.select("doc_id", F.lit(topic).alias("topic")).union(copies.select("doc_id", F.lit(topic))).write.mode("overwrite").parquet(self._path("links", batch))
        postings(stored.select("doc_id", "abstract"), without_stop_words(tokens(F.col("abstract")))).write.mode("overwrite").parquet(self._path("postings", batch))
        for df in (records, copies, stored):
            df.unpersist()
        return {"added": added, "linked": linked, "skipped": total - added - linked}


def import_folder(spark: SparkSession, source: str, corpus: Corpus, topic: str, checkpoint: str, files_per_batch: int = 50) -> StreamingQuery:
    """Everything that has arrived in ``source``, in batches; a later call goes on where this one ended."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_per_batch).load(source)
    writer = stream.writeStream.foreachBatch(lambda files, batch: corpus.add(files, batch, topic) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

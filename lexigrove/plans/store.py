"""The tables of a folder, and the postings built from them once for each session."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import weighting_tokens
from ..operators.index import postings

_held: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of so many bytes at most may be one row group, which one task would read; it is dealt over all cores before its texts are cut into words.
SMALL = 256 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents; small ones are dealt over the cores if their texts are asked for, large ones stay where they are read."""
    rows = table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "lang", "source")))
    if "text" in rows.columns and int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL:
        n = spark.sparkContext.defaultParallelism
        return rows.repartition(n, "doc_id") if "doc_id" in rows.columns else rows.repartition(n)  # what follows by document needs no further shuffle
    return rows


def held(spark: SparkSession, sf_dir: str, name: str, build, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> DataFrame:
    """``build()``, kept by this session; what is lost with an executor is computed again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = build().persist(level)
    return _held[key]


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of words without stop-words."""
    return held(spark, sf_dir, "index", lambda: postings(documents(spark, sf_dir, "doc_id", "text"), weighting_tokens(F.col("text"))))


_counts: dict[tuple[str, str, str], int] = {}


def count_of(spark: SparkSession, sf_dir: str, name: str, build) -> int:
    """The number of rows of ``build()``, counted once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _counts:
        _counts[key] = build().count()
    return _counts[key]


def release(spark: SparkSession) -> None:
    """Give up what this session holds."""
    for key in [k for k in _held if k[0] == spark.sparkContext.applicationId]:
        _held.pop(key).unpersist()

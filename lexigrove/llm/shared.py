"""Helpers that several operators of this folder use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a temporary folder of this machine is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/lexigrove-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_open: list[list[str]] = []  # paths written within each open ``scratch_tables``, the innermost last


def materialize(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Within ``scratch_tables`` the table goes when that ends; with ``keep`` it stays, or goes with the ``scratch_tables`` around that.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    for held in _open[: -1 if keep else None][-1:]:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """What is materialized within is removed at the end; a result that outlives it is materialized with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def forget(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``df`` once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


#: Bits of a ``sketch_of``, and of one of its words.
SKETCH_BITS, WORD_BITS = 24, 6


def sketch_of(rows: DataFrame, *key: str) -> DataFrame:
    """(word, bits): a bitmap of 2**SKETCH_BITS bits in which the hash of each row's ``key`` is set; it has 2**18 rows at most."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << SKETCH_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % (1 << WORD_BITS)).cast("int"))
    return materialize(rows.select(F.shiftright(place, WORD_BITS).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "sketch", keep=True)


def in_sketch(rows: DataFrame, sketch: DataFrame, *key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false if no row of the sketch has this ``key``, true if one may have it.

    The sketch is broadcast: its size is bounded whatever it was made of. An exact join follows for the rows that may match.
    """
    word, bits = free_name(rows, "_word"), free_name(rows, "_bits")
    place = F.pmod(F.xxhash64(*key), F.lit(1 << SKETCH_BITS))
    held = F.broadcast(sketch.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    joined = rows.withColumn(word, F.shiftright(place, WORD_BITS)).join(held, word, "left")
    bit = F.call_function("shiftright", F.col(bits), (place % (1 << WORD_BITS)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(word, bits)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it where ``df`` has such a column (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def refuse_clashes(kept: DataFrame, *new: str) -> None:
    """Raise an error where a column that is to be kept has the name of a new one."""
    both = {c.lower() for c in kept.columns} & {c.lower() for c in new}
    if both:
        raise ValueError(f"columns to keep have the names of new ones: {', '.join(sorted(both))}")


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def batches(stream: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``stream`` in slices of at most ``max_bytes`` (one row at least)."""
    for batch in stream:
        rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > 2 * max_bytes:  # one long text among short ones
                n //= 2
            yield batch.slice(at, n)
            at += n


def task_groups(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task of a partition that is sorted by ``task``, its first column."""
    held: list[pa.RecordBatch] = []  # of one task, the last one seen
    for batch in stream:
        task = batch.column(0).to_numpy()
        if not len(task):
            continue
        if held and held[0].column(0)[0].as_py() != task[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)]).combine_chunks()
            held = []
        held.append(batch.slice(cuts[-1]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes by the edges (left[i], right[i])."""
    label = np.arange(n)
    while left.size:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            break
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:  # follow labels to their roots
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps; every step is a pre-aggregated minimum and a sort-merge join of two
    written tables, whose hot side adaptive execution can split. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(both, "edges")
    mark = _mark(now)
    while mark[0]:
        # large star: each node links its larger neighbours to the smallest node next to it
        swapped = materialize(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "star")
        least = materialize(swapped.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = materialize(
            swapped.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large"
        )
        # small star: each node links its smaller neighbours and itself to the smallest of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        joined = large.join(low.hint("merge"), "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        then = materialize(small, "edges")
        found = _mark(then)
        for old in (now, swapped, least, large, low):
            forget(old)
        now = then
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

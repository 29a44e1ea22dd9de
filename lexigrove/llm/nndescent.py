"""Embedding near-dedup: NN-descent over blocked joins.

Equal vectors meet first: one class each, with a count. Lists of the ``neighbours`` most similar classes, of cosine ``FLOOR`` or
more (two links lead no farther), start from tables of random hyperplanes: all pairs within a block of about ``BLOCK``; a larger
one is compared chunk by chunk. There are as many tables as it takes to bring together two vectors of just the threshold with a
chance of ``1 - MISSED``. Then rounds of NN-descent refine the lists: through each class whose surroundings changed, its
neighbours, and those it is a neighbour of, are compared with one another, and what improves a list is kept, until the entries that
change are at most the share ``CONVERGED``. Blocks and joins also give reachability by links, as spanning forests. A list that
holds a link may be saturated: it is enlarged to its whole component, whose pairs are counted chunk by chunk, so nothing is capped.
``audit`` compares link counts of a bounded set of classes with brute force, at every size of table; while recall is below ``RECALL``, further tables
are added and refined; after ``TURNS`` all pairs of classes are compared, chunk by chunk. Recall is logged.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different length
do not link; rows with a null vec_id link with nothing and are not kept; repeated rows are linked copies; cosine is computed in double precision and compared with >=; each row
gives a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, components, local_components, materialize, scratch_tables, task_groups

log = logging.getLogger(__name__)

THRESHOLD = 0.9
NEIGHBOURS = 12
#: Vectors of a block on average, and the chance that no table brings together two vectors of just the threshold.
BLOCK, MISSED = 256, 0.05
#: Similarity that a neighbour has at least: of two vectors that are linked to a third, 2 * threshold**2 - 1.
FLOOR = 2 * THRESHOLD**2 - 1
#: Share of list entries that may still change, and rounds of NN-descent at most before recall is audited.
CONVERGED, ROUNDS = 0.01, 12
#: Vectors of one chunk where a block or component is too large for one task.
CHUNK = 512
#: New neighbours that one join offers to each of its members.
OFFERS = 4
#: Classes whose links are audited, the recall they must have, and how often tables are added before all pairs are compared.
AUDIT, RECALL, TURNS = 2048, 0.95, 4

EDGES = "a long, b long, sim double"  # sim 2: b is reachable from a by links, their own cosine is not given


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1, in double precision; shorter ones are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        rows = flat.reshape(len(sizes), width)
    else:
        rows = np.zeros((len(sizes), width))
        rows[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    rows = rows / np.abs(rows).max(1, keepdims=True, initial=1e-300)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def is_valid(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def block_keys(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(block, rep, embedding) of each class, once for each table: the signs of ``bits`` projections, and the length."""

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches(stream, 4 << 20):
            if not batch.num_rows:
                continue
            rows = unit_rows(batch.column(1))
            width = rows.shape[1]
            if width not in planes:  # the first components of one sequence, so that a filled row has the signs of its own length
                planes[width] = np.stack([np.random.default_rng([seed, k]).standard_normal((tables, bits)) for k in range(width)]) if width else np.zeros((0, tables, bits))
            signs = np.tensordot(rows, planes[width], 1) >= 0
            keys = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
            keys = ((keys * tables + np.arange(tables)) << 16) + np.diff(batch.column(1).offsets.to_numpy())[:, None]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), *batch.columns], ["block", "rep", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return arrow_map(classes.select("rep", "embedding"), sign, f"block long, rep long, embedding {kind}")


def dealt(rows: DataFrame, key: str, chunk: int, most: int | None = None) -> DataFrame:
    """``rows`` with a ``task``: the key, or where a key has more than ``most`` rows (``chunk``, if not given), each pair of its chunks."""
    sizes = rows.groupBy(key).count().where(F.col("count") > (most or chunk))
    hot = materialize(sizes.select(key, F.ceil(F.col("count") / chunk).cast("long").alias("chunks")), "hot")
    spread = rows.join(hot, key, "left").withColumn("mine", F.coalesce(F.pmod(F.xxhash64("rep", F.col(key), F.lit("chunk")), F.col("chunks")), F.lit(0).cast("long")))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)
    spread = spread.withColumn("other", F.explode(others))
    return spread.withColumn("task", F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")))


def block_tasks(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(task, rep, worst, embedding): tasks in which all pairs of each block meet, also of a block too large for one task."""
    return dealt(materialize(block_keys(classes, tables, bits, seed), "blocks"), "block", CHUNK, most=2 * CHUNK).withColumn("worst", F.lit(FLOOR))


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])


def compare(ids: np.ndarray, rows: np.ndarray, worst: np.ndarray, offers: int, threshold: float) -> pa.RecordBatch:
    """All pairs of some vectors: for each the ``offers`` best that are better than its worst neighbour, and a forest of links."""
    n = len(ids)
    left, right, best = [], [], []
    for at in range(0, n, 512):
        sim = rows[at : at + 512] @ rows.T
        m = len(sim)
        sim[np.arange(m), np.arange(at, at + m)] = -2
        i, j = np.nonzero(sim >= threshold)
        left.append(i + at)
        right.append(j)
        k = min(offers, n - 1)
        if k > 0:
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(sim, top, 1)
            r, c = np.nonzero(value > worst[at : at + m, None])
            best.append((r + at, top[r, c], value[r, c]))
    order = np.argsort(ids, kind="stable")  # the smallest id is the root
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    label = local_components(n, place[np.concatenate(left)], place[np.concatenate(right)])
    inner = np.flatnonzero(label != np.arange(n))
    a = [ids[order[inner]], *(ids[x[0]] for x in best)]
    b = [ids[order[label[inner]]], *(ids[x[1]] for x in best)]
    sim = [np.full(len(inner), 2.0), *(x[2] for x in best)]
    return _edges(np.concatenate(a), np.concatenate(b), np.concatenate(sim))


def compare_tasks(rows: DataFrame, offers: int, threshold: float) -> DataFrame:
    """``compare`` for each task of ``rows(task, rep, worst, embedding)``, as ``EDGES``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(stream):
            if group.num_rows > 1:
                yield compare(group.column(1).to_numpy(), unit_rows(one_chunk(group.column(3))), group.column(2).to_numpy(), offers, threshold)

    ready = rows.select("task", "rep", "worst", "embedding").repartition("task").sortWithinPartitions("task")
    return arrow_map(ready, run, EDGES)


def best_lists(edges: DataFrame, neighbours: int) -> DataFrame:
    """The ``neighbours`` best different b of each a."""
    pairs = edges.where("sim <= 1.5").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("a", "b", "sim", "rank")


def join_neighbours(classes: DataFrame, lists: DataFrame, fresh: DataFrame, neighbours: int, threshold: float) -> DataFrame:
    """One round of NN-descent: through each class that a ``fresh(a, b)`` entry touches, compare its neighbours, and those it is a neighbour of, with one another."""
    centres = materialize(fresh.select(F.col("a").alias("task")).union(fresh.select(F.col("b").alias("task"))).distinct(), "centres")
    reverse = best_lists(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), neighbours)
    own = lists.groupBy("a").agg(F.when(F.count("*") >= neighbours, F.min("sim")).otherwise(F.lit(FLOOR)).alias("worst"))
    members = lists.select(F.col("a").alias("task"), F.col("b").alias("rep")).union(reverse.select(F.col("a").alias("task"), F.col("b").alias("rep")))
    members = members.join(centres.hint("merge"), "task", "left_semi").select("task", "rep").union(centres.select("task", F.col("task").alias("rep")))
    members = materialize(members.distinct(), "members")
    known = classes.join(own, classes.rep == own.a, "left").select("rep", F.coalesce("worst", F.lit(FLOOR)).alias("worst"), "embedding")
    return compare_tasks(members.join(materialize(known, "known").hint("merge"), "rep"), OFFERS, threshold)


def descend(classes: DataFrame, lists: DataFrame, forest: DataFrame, neighbours: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(lists, forest) after rounds of NN-descent, until hardly an entry changes; what improves no list goes at once."""
    fresh = lists
    for _ in range(ROUNDS):
        new = materialize(join_neighbours(classes, lists, fresh, neighbours, threshold), "offers")
        forest = forest.union(new.where("sim > 1.5").select("a", "b"))
        before = lists
        lists = materialize(best_lists(before.select("a", "b", "sim").union(new.where("sim <= 1.5")), neighbours), "lists")
        fresh = materialize(lists.join(before.select("a", "b").hint("merge"), ["a", "b"], "left_anti").select("a", "b"), "fresh")
        if fresh.count() <= CONVERGED * lists.count():
            break
    return lists, materialize(forest, "forest")


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): the copies linked to each of ``members(root, rep, copies, embedding)`` within its root's group, all pairs counted."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(stream):
            rep, copies, mine = (group.column(k).to_numpy() for k in (1, 2, 3))
            first, second = group.column(4).to_numpy()[0], group.column(5).to_numpy()[0]
            rows = unit_rows(one_chunk(group.column(6)))
            found = np.zeros(len(rep), np.int64)
            sides = [(mine == first, mine == first)] if first == second else [(mine == first, mine == second), (mine == second, mine == first)]
            for left, right in sides:
                linked = rows[left] @ rows[right].T >= threshold
                if first == second:
                    np.fill_diagonal(linked, False)
                found[left] += linked @ copies[right]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(found)], ["rep", "links"])

    spread = dealt(members, "root", CHUNK)
    ready = spread.select("task", "rep", "copies", "mine", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "embedding").repartition("task").sortWithinPartitions("task")
    return arrow_map(ready, count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def link_graph(classes: DataFrame, forest: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(rep, copies, root, links) of each class: components of the links found, and each list with a link enlarged to its component."""
    strong = lists.where(F.col("sim") >= threshold).select("a", "b")
    roots = components(forest.union(strong))
    linked = materialize(classes.join(roots.hint("merge"), classes.rep == roots.node).select("rep", "copies", "root", "embedding"), "linked")
    links = materialize(dense_links(linked, threshold), "links")
    found = linked.select("rep", "root").join(links.hint("merge"), "rep")
    found = classes.select("rep", "copies").join(materialize(found, "found").hint("merge"), "rep", "left")
    return materialize(found.select("rep", "copies", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "graph")


def audit(classes: DataFrame, graph: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Recall of links: what ``queries`` classes, chosen by hash, have in ``graph``, against a comparison with every class.

    Links to other classes count, own copies don't; it is the mean over the chosen classes that have such links, each the same.
    """
    chosen = graph.orderBy(F.xxhash64("rep", F.lit("audit"))).limit(queries).select("rep", "copies", F.col("links").alias("have"))
    rows = classes.join(F.broadcast(chosen.select("rep", "have")), "rep").select("rep", "copies", "have", "embedding").collect()  # of ``queries`` rows
    by_width: dict[int, list] = {}
    for r in rows:
        by_width.setdefault(len(r["embedding"]), []).append(r)
    sets = {w: ([r["rep"] for r in x], unit_rows(pa.array([r["embedding"] for r in x], pa.list_(pa.float64())))) for w, x in by_width.items()}
    held = classes.sparkSession.sparkContext.broadcast(sets)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches(stream, 2 << 20):
            if batch.num_rows:
                vectors, copies = unit_rows(batch.column(1)), batch.column(0).to_numpy()
                widths = np.diff(batch.column(1).offsets.to_numpy())
                for width, (ids, queries_) in held.value.items():
                    same = widths == width
                    sums = (vectors[same][:, :width] @ queries_.T >= threshold).T @ copies[same]
                    for k, n in zip(ids, sums.tolist(), strict=True):
                        total[k] = total.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "links"])

    true = {r["rep"]: r["links"] for r in arrow_map(classes.select("copies", "embedding"), count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links")).collect()}
    shares = [min(1.0, (r["have"] + 1 - r["copies"]) / (true[r["rep"]] - r["copies"])) for r in rows if true.get(r["rep"], 0) > r["copies"]]
    return sum(shares) / len(shares) if shares else 1.0


def table_plan(total: int, threshold: float, block: int) -> tuple[int, int]:
    """(bits, tables): so many hyperplanes that a block of unrelated vectors holds ``block`` on average, and so many tables that two vectors
    of cosine ``threshold`` share no block with a chance of ``MISSED``."""
    bits = max(0, min(40, math.ceil(math.log2(max(1, total) / block))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISSED) / math.log1p(-together))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    tables: int | None = None,
    block: int = BLOCK,
    report: Callable[[int, float], None] | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors(vec_id, embedding)``.

    Two vectors are linked if their cosine is ``threshold`` or more. ``report`` is told the recall after each turn. ``tables``, if
    given, replaces the number of ``table_plan``.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    valid = rows.where(is_valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    with scratch_tables(vectors.sparkSession):
        classes = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "embedding"), "classes")
        bits, planned = table_plan(classes.count(), threshold, block)
        lists = forest = None
        for turn in range(TURNS + 1):
            exact = turn == TURNS  # further tables have not reached the recall: one block holds all
            found = materialize(compare_tasks(block_tasks(classes, 1 if exact else tables or planned, 0 if exact else bits, turn), OFFERS, threshold), "found")
            reached, offered = found.where("sim > 1.5").select("a", "b"), found.where("sim <= 1.5")
            forest = reached if forest is None else forest.union(reached)
            lists = materialize(best_lists(offered if lists is None else lists.select("a", "b", "sim").union(offered), neighbours), "lists")
            if not exact:
                lists, forest = descend(classes, lists, forest, neighbours, threshold)
            graph = link_graph(classes, forest, lists, threshold)
            recall = audit(classes, graph, threshold)
            log.info("turn %d: recall %.4f of links", turn, recall)
            if report:
                report(turn, recall)
            if recall >= RECALL:
                break
        of = rows.join(classes.select("embedding", "rep").hint("merge"), "embedding", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("rep"))
        placed = materialize(of, "placed").join(graph.hint("merge"), "rep", "left")
        root = F.coalesce("root", "vec_id")
        result = placed.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))
        return materialize(result, "result", keep=True)

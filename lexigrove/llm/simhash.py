"""SimHash near-dedup: fingerprints of word shingles, joined within a small Hamming distance by a binary trie self-join.

``fingerprints`` votes per bit over a document's shingles. ``links`` finds the pairs of different fingerprints that differ
in at most ``distance`` bits: of distance + 1 blocks of bits, two such fingerprints share one, so each block value makes a
bucket, and a bucket's fingerprints are joined by traversing pairs of trie nodes together, adding up differing bits and
dropping pairs that exceed the budget. A bucket beyond ``bucket`` fingerprints is dealt into chunks, and each pair of
chunks is a task of its own, in which only pairs across the two chunks are traversed, so that no task holds a hot bucket
and no pair is lost. A task returns a spanning forest of its links, never all pairs. ``near_duplicates`` labels documents
with the connected components; equal fingerprints meet before any of this, and a fingerprint is a node by itself, whatever
ids its documents have.

``similar_documents`` links documents by the Jaccard similarity of their sets of shingles. Their fingerprints have 256 bits;
buckets are the values of some sampled bits, in as many tables as it takes to bring together two sets of just that
similarity with a chance of ``1 - MISSED``. Within a bucket the trie of the first 64 bits gives pairs, which all bits then
confirm within ``NEAR_BITS``. Documents reached that way make up groups, and within a group all pairs of sets are compared
exactly, chunk by chunk.

Defined results: a null text is an empty one; texts without a word have fingerprint zero and are linked like others;
repeated rows have one component; a null doc_id is kept and takes part as any other id, but is never a representative
unless nothing else is in its component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, components, in_sketch, local_components, materialize, scratch_tables, sketch_of, task_groups

WORDS = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of a bucket (or of one of its chunks) that one task joins.
BUCKET = 1024
#: Node pairs with at most so many pairs of leaves are compared leaf by leaf.
LEAVES = 64
#: Candidate pairs that are held at a time.
CANDIDATES = 250_000
LANE = 60_000  # shingles that 16-bit lanes can count

#: Documents with this similarity of their sets of five-word shingles are near copies.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: 64-bit words of a long fingerprint; differing bits allowed in the first word, and in all of them.
LONG, TRIE_BITS, NEAR_BITS = 4, 20, 72
#: Fingerprints of a bucket on average, and the chance to miss a pair that differs in ``DIFFER`` of its bits.
FILL, MISSED, DIFFER = 1024, 0.01, 0.17
#: Documents and shingles of a chunk of a group.
CHUNK, CHUNK_SHINGLES = 512, 1 << 18


def _lanes() -> np.ndarray:
    """For each byte value two words of four 16-bit lanes, one lane a bit."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([(bits[:, 4 * k : 4 * k + 4].astype(np.uint64) << (16 * np.arange(4, dtype=np.uint64))).sum(1, dtype=np.uint64) for k in (0, 1)])


LANES = _lanes()


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``sizes`` (none empty) of 64-bit hashes: the bits set in over half of a group."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    cuts, owner = [], []
    for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        for at in range(start, start + size, LANE):
            cuts.append(at)
            owner.append(k)
    counts = np.zeros((len(cuts), 64), np.int64)
    shifts = 16 * np.arange(4, dtype=np.uint64)
    for byte in range(8):
        values = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)
        for half in (0, 1):
            sums = np.add.reduceat(LANES[half][values], cuts)
            counts[:, 8 * byte + 4 * half : 8 * byte + 4 * half + 4] = (sums[:, None] >> shifts) & np.uint64(0xFFFF)
    total = np.add.reduceat(counts, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
    on = 2 * total > sizes[:, None]
    return (on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``words`` words of the lower-cased text; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), seed)] if found else []
    return [xxh64_intdigest(x, seed) for x in map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))]


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long) for each row of ``docs(doc_id, text)``."""

    def hash_texts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1 << 20):
            found, sizes = [], []
            for text in batch.column(1).to_pylist():
                new = shingle_hashes(text or "", words, seed)
                sizes.append(len(new))
                found.append(np.array(new, np.uint64))
            counts = np.array(sizes)
            prints = np.zeros(len(sizes), np.uint64)
            if counts.any():
                prints[counts > 0] = majority(np.concatenate(found), counts[counts > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), hash_texts, "doc_id long, fingerprint long")


def trie_pairs(keys: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose keys differ in at most ``distance`` bits, between or within runs of keys.

    ``left`` and ``right`` hold (begin, end) of runs of sorted keys, which are compared row by row: a run with itself (each
    pair once) or with another one. A trie node at depth d is a part of a run with the same first d bits. The frontier of
    node pairs moves down one level at a time.
    """
    (a0, a1), (b0, b1) = left.T, right.T
    wrong = np.zeros(len(a0), np.int8)
    for depth in range(65):
        small = (a1 - a0) * (b1 - b0) <= LEAVES
        if depth == 64:
            small[:] = True
        if small.any():
            yield from _leaf_pairs(keys, a0[small], a1[small], b0[small], b1[small], distance)
            keep = ~small
            a0, a1, b0, b1, wrong = a0[keep], a1[keep], b0[keep], b1[keep], wrong[keep]
        if not len(a0):
            return
        bit = np.uint64(63 - depth)
        ones = np.concatenate(([0], np.cumsum((keys >> bit) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where a node's keys with a one begin
        same = a0 == b0
        parts = [(a0, am, b0, bm, wrong, None), (am, a1, bm, b1, wrong, None), (a0, am, bm, b1, wrong + 1, None), (am, a1, b0, bm, wrong + 1, ~same)]
        new = []
        for x0, x1, y0, y1, w, only in parts:
            keep = (x1 > x0) & (y1 > y0) & (w <= distance)
            if only is not None:
                keep &= only
            new.append((x0[keep], x1[keep], y0[keep], y1[keep], w[keep]))
        a0, a1, b0, b1, wrong = (np.concatenate(x) for x in zip(*new, strict=True))


def _leaf_pairs(keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The matching leaf pairs of small node pairs, a bounded number of candidates at a time."""
    width, total = b1 - b0, (a1 - a0) * (b1 - b0)
    for part in np.split(np.arange(len(total)), np.flatnonzero(np.diff(np.cumsum(total) // CANDIDATES)) + 1):
        which = np.repeat(part, total[part])
        nth = np.arange(len(which)) - np.repeat(np.cumsum(total[part]) - total[part], total[part])
        i, j = a0[which] + nth // width[which], b0[which] + nth % width[which]
        good = (i < j) | (a0[which] != b0[which])
        good &= np.bitwise_count(keys[i] ^ keys[j]) <= distance
        good &= i != j
        if good.any():
            yield i[good], j[good]


def hot_buckets(rows: DataFrame, bucket: int) -> DataFrame:
    """(key, chunks) of the keys of ``rows(key)`` that have more than ``bucket`` rows."""
    return materialize(rows.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("long").alias("chunks")), "hot")


def deal(rows: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """``rows(key, ...)`` with a ``task``, the key, or for a hot one each pair of its chunks, and a ``side``, the chunk that column ``by`` puts a row into."""
    spread = rows.join(hot, "key", "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64(by, F.lit("side")), F.col("chunks")), F.lit(0).cast("long")))
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)))
    return spread.withColumn("task", F.xxhash64("key", F.least("side", "_other"), F.greatest("side", "_other"))).drop("_other", "chunks")


def bucket_links(rows: DataFrame, words: list[str], distance: int, most: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes of ``rows(task, side, node, words...)``: a spanning forest, task by task, of the pairs of different
    ``words[0]`` within ``distance`` bits that, if ``most`` is given, differ in at most so many bits of all words."""

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(stream)  # some tasks, each of two chunks at most
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        task, side, node, *keys = (table.column(k).to_numpy() for k in range(3 + len(words)))
        keys = [k.view(np.uint64) for k in keys]
        order = np.lexsort((keys[0], side, task))
        task, side, node, keys = task[order], side[order], node[order], [k[order] for k in keys]
        begin = np.flatnonzero((np.diff(task, prepend=task[0] - 1) != 0) | (np.diff(side, prepend=side[0] - 1) != 0))
        runs = np.stack([begin, np.append(begin[1:], len(task))], 1)
        paired = np.flatnonzero(task[begin[1:]] == task[begin[:-1]])  # a run and the next one are a task's two chunks
        alone = np.ones(len(runs), bool)
        alone[paired] = alone[paired + 1] = False
        left = np.concatenate([runs[alone], runs[paired]])
        right = np.concatenate([runs[alone], runs[paired + 1]])
        rank = np.argsort(left[:, 0], kind="stable")
        left, right = left[rank], right[rank]
        # small buckets share frontiers; a large one has its own
        at = 0
        while at < len(left):
            upto = at + 1
            while upto < len(left) and right[upto, 1] - left[at, 0] <= 8 * bucket:
                upto += 1
            first, last = int(left[at, 0]), int(right[upto - 1, 1])
            words_ = [k[first:last] for k in keys]
            ends_a, ends_b = [], []
            for i, j in trie_pairs(words_[0], left[at:upto] - first, right[at:upto] - first, distance):
                if most is not None:
                    near = sum(np.bitwise_count(k[i] ^ k[j]).astype(np.int16) for k in words_) <= most
                    i, j = i[near], j[near]
                ends_a.append(i)
                ends_b.append(j)
            if ends_a:
                label = local_components(last - first, np.concatenate(ends_a), np.concatenate(ends_b))
                inner = np.flatnonzero(label != np.arange(last - first))
                mine = node[first:last]
                yield pa.RecordBatch.from_arrays([pa.array(mine[inner]), pa.array(mine[label[inner]])], ["a", "b"])
            at = upto

    return arrow_map(rows.repartition("task").select("task", "side", "node", *words), join, "a long, b long")


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different ``prints(fingerprint)``: a spanning forest, task by task, of all pairs within ``distance`` bits."""
    blocks, bits = distance + 1, 64 // (distance + 1)
    value = lambda k: F.shiftrightunsigned("fingerprint", k * bits).bitwiseAND(F.lit((1 << bits) - 1))
    keyed = prints.select("fingerprint", F.explode(F.array(*[value(k) * blocks + k for k in range(blocks)])).alias("key"))
    dealt = deal(keyed, hot_buckets(keyed, bucket), "fingerprint").withColumn("node", F.col("fingerprint"))
    return bucket_links(dealt, ["fingerprint"], distance, bucket=bucket)


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) of each row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits; component_id is the smallest doc_id
    reachable by links, the document's own included.
    """
    prints = materialize(fingerprints(docs, words, seed), "prints")
    with scratch_tables(docs.sparkSession):
        distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "distinct")
        classes = smallest_of(distinct, components(links(distinct, distance, bucket)), "fingerprint", keep=True)
    return (
        prints.join(classes.select("fingerprint", "component_id").hint("merge"), "fingerprint")
        .select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
    )


def smallest_of(nodes: DataFrame, roots: DataFrame, node: str, keep: bool = False) -> DataFrame:
    """(node, root, component_id) of ``nodes(node, rep)``: the smallest rep of its component in ``roots(node, root)``, or its own rep."""
    linked = materialize(nodes.join(roots.hint("merge"), nodes[node] == roots["node"]).select(nodes[node].alias("in"), "rep", "root"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("least")), "least")
    placed = materialize(linked.select("in", "root").join(least.hint("merge"), "root").select("in", "root", "least"), "placed")
    found = nodes.join(placed.hint("merge"), nodes[node] == placed["in"], "left")
    return materialize(found.select(node, F.coalesce("root", node).alias("root"), F.coalesce("least", "rep").alias("component_id")), "placed", keep)


def long_fingerprint(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``LONG`` words for each consecutive group of distinct 64-bit hashes: majorities of the hashes, mixed anew for each word."""
    out = np.zeros((len(sizes), LONG), np.uint64)
    some = sizes > 0
    for k in range(LONG if some.any() else 0):
        mixed = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        out[some, k] = majority(mixed ^ (mixed >> np.uint64(31)), sizes[some])
    return out


def long_fingerprints(docs: DataFrame, words: int, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, c0, c1, f0.. ) of each row of ``docs(doc_id, text_hash, text)``: two hashes of its words and its long
    fingerprint. ``text_hash`` tells the texts of one id apart."""
    names = ["doc_id", "text_hash", "c0", "c1", *(f"f{k}" for k in range(LONG))]

    def hash_texts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches(stream, 1 << 20):
            sets, classes = [], []
            for text in batch.column(2).to_pylist():
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                whole = b" ".join(found)
                classes.append((xxh64_intdigest(whole, 1), xxh64_intdigest(whole, 2)))
                sets.append(distinct_shingles(found, words, seed))
            sizes = np.array([len(x) for x in sets])
            prints = long_fingerprint(np.concatenate(sets), sizes).view(np.int64) if sets else np.zeros((0, LONG), np.int64)
            c = np.array(classes, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), batch.column(1), *(pa.array(x) for x in (c[:, 0], c[:, 1], *prints.T))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs, hash_texts, ", ".join(f"{n} long" for n in names))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")


def distinct_shingles(found: list[bytes], words: int, seed: int) -> np.ndarray:
    """The different XXH64 of each run of ``words`` of the words ``found``; of all of them if they are fewer."""
    from xxhash import xxh64_intdigest

    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), seed)] if found else [], np.uint64)
    return np.unique(np.array([xxh64_intdigest(x, seed) for x in map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))], np.uint64))


def sampled_keys(classes: DataFrame, bits: int, tables: int, full: bool) -> DataFrame:
    """The bucket of each of ``classes(node, f0..)`` in each table, as (key) or, if ``full``, as (key, node, f0..)."""
    prints = [f"f{k}" for k in range(LONG)]
    places = np.random.default_rng([bits, tables]).permuted(np.tile(np.arange(64 * LONG), (tables, 1)), axis=1)[:, :bits]
    weights = 1 << np.arange(bits, dtype=np.int64)

    def sample(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1 << 20):
            raw = np.stack([batch.column(1 + k).to_numpy() for k in range(LONG)], 1)
            on = np.unpackbits(np.ascontiguousarray(raw).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            for t in range(tables):
                key = pa.array((on[:, places[t]] @ weights) * tables + t)
                yield pa.RecordBatch.from_arrays([key, *batch.columns], ["key", "node", *prints]) if full else pa.RecordBatch.from_arrays([key], ["key"])

    schema = "key long, node long, " + ", ".join(f"{p} long" for p in prints)
    return arrow_map(classes.select("node", *prints), sample, schema if full else "key long")


def table_plan(total: int) -> tuple[int, int]:
    """(bits, tables): so many sampled bits that buckets of unrelated fingerprints hold ``FILL`` on average, and so many tables that a pair
    that differs in ``DIFFER`` of its bits shares no bucket with a chance of ``MISSED``."""
    bits = max(0, math.ceil(math.log2(max(1, total) / FILL)))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** bits))) if bits else 1


def similar_sets(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one of the sets ``left`` and one of ``right`` whose Jaccard similarity is ``similarity`` or more; two empty sets are alike.

    ``hashes`` are the members of all sets, ``owner`` the set of each. Members of one set only are no part of any intersection.
    """
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[inverse]
    keep = shared[inverse]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((len(sizes), width), np.float32)
        held[owner[a:b], column[a:b] - k * width] = 1
        both += held[left] @ held[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both.astype(np.float64)
    alike = np.where(union > 0, both / np.maximum(union, 1), 1.0) >= similarity
    i, j = np.nonzero(alike)
    return left[i], right[j]


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes of ``sets(group, node, size, hashes)``: a spanning forest, task by task, of all similar pairs of a group."""

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(stream):
            side, node, sizes = (group.column(k).to_numpy() for k in (1, 2, 3))
            if len(node) < 2:
                continue
            hashes = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint64)
            first, second = side.min(), side.max()
            a, b = similar_sets(np.repeat(np.arange(len(node)), sizes), hashes, sizes, np.flatnonzero(side == first), np.flatnonzero(side == second), similarity)
            label = local_components(len(node), a, b)
            inner = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[inner]), pa.array(node[label[inner]])], ["a", "b"])

    keyed = sets.withColumnRenamed("group", "key")
    large = keyed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("long").alias("chunks")).where("chunks > 1")
    dealt = deal(keyed, materialize(large, "hot"), "node").select("task", "side", "node", "size", "hashes")
    return arrow_map(dealt.repartition("task").sortWithinPartitions("task"), join, "a long, b long")


def shingle_sets(docs: DataFrame, words: int, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text_hash, text)`` as (doc_id, text_hash, size, hashes): its different shingles, eight bytes each."""

    def hash_texts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1 << 20):
            sets = [distinct_shingles((x or "").encode("utf-8", "surrogatepass").lower().split(), words, seed) for x in batch.column(2).to_pylist()]
            columns = [*batch.columns[:2], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "size", "hashes"])

    return arrow_map(docs, hash_texts, "doc_id long, text_hash long, size long, hashes binary")


def similar_documents(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, root, component_id) of each row of ``docs(doc_id, text)`` that has an id.

    Texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more; component_id is the
    smallest doc_id reachable by links, ``root`` a number of the component (ids may be repeated with other texts). Texts of the same
    words are one class; each class is compared by one of its texts.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_hash(F.col("text")), "text")
    prints = [f"f{k}" for k in range(LONG)]
    with scratch_tables(docs.sparkSession):
        rows = materialize(long_fingerprints(docs, words, seed), "prints")
        least = rows.groupBy("c0", "c1", *prints).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        numbered = least.select("c0", "c1", *prints, F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("node"))
        classes = materialize(numbered, "classes")
        bits, tables = table_plan(classes.count())
        hot = hot_buckets(sampled_keys(classes, bits, tables, False), 2 * BUCKET)
        dealt = deal(sampled_keys(classes, bits, tables, True), hot, "node")
        groups = components(bucket_links(dealt, prints, TRIE_BITS, NEAR_BITS))
        members = classes.join(groups.hint("merge"), "node").select("node", F.col("root").alias("group"), F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash"))
        members = materialize(members, "members")
        # texts are not shuffled, only the shingles of what may be a member
        likely = in_sketch(docs, sketch_of(members, "doc_id", "text_hash"), "doc_id", "text_hash", flag="likely").where("likely")
        sets = shingle_sets(likely.select("doc_id", "text_hash", "text"), words, seed).join(members.hint("merge"), ["doc_id", "text_hash"])
        sets = materialize(sets.select("group", "node", "size", "hashes"), "sets", compression="zstd")
        placed = smallest_of(classes.select("node", "rep"), components(similar_links(sets, similarity)), "node")
        found = materialize(classes.select("c0", "c1", "node").join(placed.hint("merge"), "node").select("c0", "c1", "root", "component_id"), "found")
        result = rows.select("doc_id", "text_hash", "c0", "c1").join(found.hint("merge"), ["c0", "c1"]).select("doc_id", "text_hash", "root", "component_id")
        return materialize(result, "groups", keep=True)

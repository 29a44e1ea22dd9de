"""Packing: best-fit decreasing over a segment tree of remaining capacities.

Documents are tokenized where they are read; overlong ones are first cut into full windows, each a sequence of its own.
What remains of a document (shorter than a window) is dealt by its row's number into shards of about ``SHARD`` pieces, so that
rows alike in everything part too, and each shard is packed on its own: longest piece first, into the open window that it fits most tightly. The segment tree has a leaf for
each remaining capacity, so a piece costs log2(window) steps, and a shard's memory does not depend on the corpus.
Only (doc_id, start, length, crc) is shuffled, never text or ids.

Defined results: a null text is an empty one; an empty document is one piece of length 1 (its end mark); equal lengths are
packed by doc_id, then by checksum; a null doc_id stays null; repeated rows are packed as often as they occur; an empty table gives no rows; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, materialize, texts_of

WINDOW = 2048
END_ID = 1
#: Pieces a shard holds on average.
SHARD = 4096
#: Words a worker remembers the ids of (as many again are kept of those before them), and their longest length.
MEMORY, LONGEST = 250_000, 48

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordIds(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of stretches of text without white space.

    The tokenizer never merges across ASCII white space, so a text's ids are those of its stretches in order. It also
    parts letters from marks that follow them, so a stretch of letters with marks at its end is looked up in two parts:
    its letters, in lower case and byte-level form, go to the merge table directly. Anything else goes to the tokenizer,
    and so do whole texts with the separators U+001C..1F, at which Python splits and the tokenizer does not.
    """

    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.old_letters: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level BPE shows as themselves
        other = [b for b in range(256) if b not in set(plain)]
        self.shown = {b: 256 + k for k, b in enumerate(other)}

    def fresh(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_letters(self, word: str) -> bytes:
        """The ids of a lower-case NFC word of letters only."""
        ids = self.letters.get(word) or self.old_letters.get(word)
        if ids is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
            ids = array("I", [x.id for x in self.merge(shown)]).tobytes()
            if len(self.letters) >= MEMORY:
                self.letters, self.old_letters = {}, self.letters
        self.letters[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if len(word) > LONGEST:
                return self.fresh(word)
            bare = word.rstrip(self.MARKS)
            lower = bare.lower()
            # not a capital sigma, whose lower case depends on its place, nor a letter whose lower case has a mark of its own
            if bare.isalpha() and (bare.isascii() or "\u03a3" not in bare and lower.isalpha() and is_normalized("NFC", bare) and is_normalized("NFC", lower)):
                ids = self.of_letters(lower)
                if len(bare) < len(word):
                    ids += self[word[len(bare) :]]
            else:
                ids = self.fresh(word)
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.fresh(text)
        return b"".join(map(self.__getitem__, text.split()))


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory for each worker process and vocabulary; it outlives a task."""
    if path not in _known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _known[path] = WordIds(path)
    return _known[path]


def cut(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows of a document's ids and of the rest, if any."""
    n, view = len(ids) // 4, memoryview(ids)
    return [(a, min(window, n - a), zlib.crc32(view[4 * a : 4 * min(n, a + window)])) for a in range(0, n, window)]


def token_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, as ``PIECES``: its ids, with ``end_id`` appended, cut into windows."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(vocabulary).of
        for batch in batches(stream):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = of(text) + end
                rows += [(doc, *piece, len(ids) // 4) for piece in cut(ids, window)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), tokenize, PIECES)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose node tells whether any leaf below it holds a window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.held[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def tightest(self, length: int) -> int:
        """The smallest capacity of an open window that is at least ``length``, or -1."""
        tree, node = self.tree, self.leaves + length
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up, until a right neighbour has something
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        window = self.held[capacity].pop()
        if not self.held[capacity]:
            node = self.leaves + capacity
            self.tree[node] = 0
            node >>= 1
            while node and not (self.tree[2 * node] or self.tree[2 * node + 1]):
                self.tree[node] = 0
                node >>= 1
        return window


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of each piece; ``lengths`` come longest first."""
    spaces, where, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        capacity = spaces.tightest(length)
        if capacity < 0:
            number, capacity, n = n, window, n + 1
        else:
            number = spaces.take(capacity)
        where.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            spaces.add(capacity - length, number)
    return where, offsets


def pack(pieces: DataFrame, window: int = WINDOW, shards: int = 1) -> DataFrame:
    """Give each of ``pieces`` (a written table, as ``PIECES``) its sequence and its offset there, as ``PACKED``."""

    def pack_shards(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches_ = list(stream)  # a few shards: five numbers for each of some thousand pieces
        if not batches_:
            return
        table = pa.Table.from_batches(batches_)
        ids = table.column(1).combine_chunks()
        doc = ids.fill_null(-(2**63)).to_numpy()
        shard, start, length, crc, tokens = (table.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        order = np.lexsort((start, crc, doc, -length, shard))
        bounds = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, bounds):
            where, offsets = best_fit_decreasing(length[part].tolist(), window)
            # the shard above, the sequence's number in the shard below
            sequence = (shard[part[0]].astype(np.int64) << 32) + np.array(where, np.int64)
            columns = [ids.take(pa.array(part)), start[part], length[part], crc[part], tokens[part], sequence, np.array(offsets, np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # rows are numbered as they stand in a written table, so a task that runs again deals them alike
    shard = F.when(F.col("length") == window, F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt = pieces.select(shard.alias("shard"), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    rest = arrow_map(dealt.where("shard >= 0").repartition("shard"), pack_shards, PACKED)
    # a full window needs no search: it is a sequence of its own, numbered below zero
    full = pieces.where(F.col("length") == window).select(
        *[c.split(" ")[0] for c in PIECES.split(", ")], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return rest.union(full)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``window`` tokens: one row for each piece, as ``PACKED``."""
    pieces = materialize(token_pieces(docs, vocabulary, window), "pieces")
    shards = max(1, -(-pieces.where(F.col("length") < window).count() // shard))
    return pack(pieces, window, shards)


def sequence_lengths(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, filled, padded) of each sequence: it is padded to ``window``, except where it is filled to a power of two."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.withColumn("padded", F.when(power, F.col("filled")).otherwise(F.lit(window).cast("long")))

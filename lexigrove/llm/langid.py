"""Language ID: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams of a bounded sample of labelled rows (``per_language`` documents of each language at most, on average,
chosen by hash) on the executors, and gives the driver one count vector for each language; ``predict``
broadcasts the matrix of log-probabilities and scores batches in numpy: an index gather and one sum for each document.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a model without languages says ``und`` for
all; rows with a null label or text are not learned from; ties go to the language that sorts first; each row gives a row;
further columns can be kept by name, but for those that have the name of a new one, which raise an error. Rows without an id are
learned from or not together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, refuse_clashes

ORDERS = (2, 3)
BITS = 15
#: Documents of each language that a model learns from, about; their whole texts are read.
PER_LANGUAGE = 3000
#: Labels that a model can have; beyond that the most frequent ones.
MOST_LANGUAGES = 512
FIT_TASKS = 8
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # float32, buckets of all orders x languages
    prior: np.ndarray


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    found = np.zeros(0x110000, bool)
    found[[c for c in range(0x20000) if chr(c).isalpha()]] = True
    found[[c for c in range(0x20000, 0x33480) if chr(c).isalpha()]] = True
    return found


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, text of each bucket's gram, number of letters of each text).

    Letters are lower-cased, a run of anything else is one boundary; grams of each order are hashed into 2**BITS buckets.
    """
    lowered = [x.lower() for x in texts]
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) + 1 for x in lowered])
    owner = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letters()[code]
    count = np.bincount(owner[is_letter], minlength=len(texts))
    keep = is_letter | np.concatenate(([True], is_letter[:-1]))  # the first of each run of other characters
    code = np.where(is_letter, code, 32)[keep].astype(np.uint32)
    owner = owner[keep]
    buckets, owners = [], []
    for k, order in enumerate(ORDERS):
        n = len(code) - order + 1
        if n <= 0:
            continue
        value = np.zeros(n, np.uint32)
        for j in range(order):
            value = (value ^ code[j : j + n]) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
        inside = owner[:n] == owner[order - 1 :]
        buckets.append((value[inside] >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS))
        owners.append(owner[:n][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.intp), count
    return np.concatenate(buckets), np.concatenate(owners), count


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, smoothing: float = 0.1, most: int = MOST_LANGUAGES) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``: about ``per_language`` documents of each language, or all if they are fewer.

    If there are more than ``most`` labels, the most frequent ones are learned (ties: those that sort first). Counts are summed by
    language on the executors; the driver gets one vector for each language.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((len(ORDERS) << BITS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / sizes[x]))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang").repartition(FIT_TASKS)
    buckets = len(ORDERS) << BITS

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches(stream, 2 << 20):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            found, owner, _ = gram_buckets(texts)
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + np.bincount(found[(langs == lang)[owner]], minlength=buckets)
        yield vectors(total)

    def summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in stream:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(counts, np.int64)
        yield vectors(total)

    def vectors(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])

    parts = arrow_map(chosen, count, "lang string, counts binary")
    learned = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in arrow_map(parts.repartition("lang"), summed, "lang string, counts binary").collect()}
    total = np.stack([learned.get(x, np.zeros(buckets, np.int64)) for x in languages]) + smoothing
    weights = np.concatenate([np.log(x / x.sum(1, keepdims=True)) for x in np.split(total, len(ORDERS), axis=1)], axis=1)
    documents = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.ascontiguousarray(weights.T, dtype=np.float32), np.log(documents / documents.sum()))


def score(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The most probable language of each text and its posterior probability."""
    n = len(model.languages)
    found, owner, count = gram_buckets(texts)
    sums = np.tile(model.prior, (len(texts), 1)) if n else np.zeros((len(texts), 0))
    for k in range(n):
        sums[:, k] += np.bincount(owner, weights=model.weights[found, k], minlength=len(texts))
    known = (count > 0) & (n > 0)
    if not n:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = sums.argmax(1)
    posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
    return names, np.where(known, posterior, 0.0)


def predict(docs: DataFrame, model: Model, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(kept columns, lang_pred, score) of each row of ``docs(text, ...)``; ``names`` gives the new columns other names."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of MOST_LANGUAGES x buckets at most
    kept = docs.select(*keep)
    refuse_clashes(kept, *names)

    def compute(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 2 << 20):
            found, scores = score([x or "" for x in batch.column(len(keep)).to_pylist()], held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores)], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return arrow_map(docs.select(*keep, "text"), compute, f"{schema + ', ' if schema else ''}`{names[0]}` string, `{names[1]}` double")


def is_held_out(doc_id: Column) -> Column:
    """One third of all ids: documents that no model of the queries learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))

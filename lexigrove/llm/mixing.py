"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token weights are summed per cell (source, language, topic) and raked to target marginals: each step scales one
dimension to its target, until all agree. Cells are summed before anything is shuffled; raking works on cells only, as
DataFrame steps if they are many, or in the driver's memory up to ``DRIVER_CELLS``. A document is kept if a hash of its id falls below
its cell's probability, so a sample is the same on every run and does not depend on other documents.

Defined results: a null label is a label of its own, and so is a missing topic; a null text has 0 tokens; labels without a target share what the
targets leave, in proportion to their tokens; targets of labels that do not occur are given up and the rest scaled to 1;
repeated rows with one id are kept or dropped together, and so are rows without an id that have one text; an empty table gives no rows; all columns of the input are kept, also where
a new column would have had the name.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from .shared import free_name, materialize

log = logging.getLogger(__name__)

DIMENSIONS = ("source", "lang", "topic")
DRIVER_CELLS = 100_000
STEPS = 50
TOLERANCE = 1e-6
SEED = "mixing"

#: The characters whose share tells a form.
FORMS = {"table": "|", "markup": "#$%&*", "numeric": "0123456789", "shouted": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: For each dimension the shares of some labels, or an exponent: shares in proportion to the present ones to that power.
Targets = dict[str, dict[str, float] | float]


def topic_of(text: Column) -> Column:
    """A topic by form, from shares of the whole text, for tables that have none: table, markup, numeric, shouted or prose.

    One pass leaves the characters that count; classes are spelled out, as the JVM looks single characters up in a table.
    """
    text = F.coalesce(text, F.lit(""))
    left = F.regexp_replace(text, f"[^{''.join(FORMS.values())}]++", "")
    held = F.struct(F.length(text).alias("size"), left.alias("left"), F.length(left).alias("n"))

    def named(x: Column) -> Column:
        rest = lambda chars: 1 - (x["n"] - F.length(F.translate(x["left"], chars, ""))) / F.greatest(x["size"], F.lit(1))
        return (
            F.when(x["n"] == 0, "prose")
            .when(rest(FORMS["table"]) < 0.97, "table")
            .when(rest(FORMS["markup"]) < 0.9, "markup")
            .when(rest(FORMS["numeric"]) < 0.98, "numeric")
            .when(rest(FORMS["shouted"]) < 0.7, "shouted")
            .otherwise("prose")
        )

    return let(held, named)


def token_count(text: Column) -> Column:
    """Words of a text, as a measure of its tokens."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0b\\f\\r]++")), F.lit(0)).cast("long")


def cells_of(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimensions, tokens) of ``docs(dimensions, n_tokens)``; a null label reads as an empty one."""
    return docs.groupBy(*[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dimensions]).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def full_targets(present: dict[str, float], wanted: dict[str, float] | float) -> dict[str, float]:
    """Targets of the labels that occur, with their tokens, adding up to 1."""
    if not isinstance(wanted, dict):
        powers = {k: v**wanted if v > 0 else 0.0 for k, v in present.items()}
        total = sum(powers.values()) or 1.0
        return {k: v / total for k, v in powers.items()}
    named = {k: v for k, v in wanted.items() if present.get(k, 0) > 0}
    rest = {k: v for k, v in present.items() if k not in named}
    left = max(0.0, 1 - sum(named.values())) if sum(rest.values()) else 0.0
    total = sum(rest.values())
    out = named | {k: left * v / total if total else 0.0 for k, v in rest.items()}
    scale = sum(out.values())
    return {k: v / scale for k, v in out.items()} if scale else out


def rake(cells: list[tuple], targets: list[dict[str, float]], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[float]:
    """Weights of ``cells`` (labels..., tokens), adding up to 1, whose marginals are ``targets``, as far as ``steps`` steps bring them."""
    total = sum(c[-1] for c in cells) or 1.0
    weight = [c[-1] / total for c in cells]
    for _ in range(steps):
        off = 0.0
        for d, target in enumerate(targets):
            sums: dict[str, float] = {}
            for c, w in zip(cells, weight, strict=True):
                sums[c[d]] = sums.get(c[d], 0.0) + w
            off = max(off, *(abs(s - target[k]) for k, s in sums.items()), 0.0)
            weight = [w * target[c[d]] / sums[c[d]] if sums[c[d]] else 0.0 for c, w in zip(cells, weight, strict=True)]
        if off <= tolerance:
            return weight
    if cells:
        log.warning("marginals are %.2g off after %d steps of raking", off, steps)
    return weight


def rake_frames(cells: DataFrame, targets: Targets, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``rake`` for any number of cells: (dimensions, tokens, weight). A marginal has as many rows as its dimension has labels."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    goals = {}
    for d, wanted in targets.items():
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("tokens"))
        if not isinstance(wanted, dict):
            powers = sums.select(d, F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(float(wanted)))).otherwise(0.0).alias("power"))
            goals[d] = materialize(powers.select(d, (F.col("power") / (powers.agg(F.sum("power")).first()[0] or 1.0)).alias("goal")), "goal")
            continue
        named = spark.createDataFrame([(k, float(v)) for k, v in wanted.items()], f"{d} string, wanted double") if wanted else spark.createDataFrame([], f"{d} string, wanted double")
        known = sums.join(named, d, "left")
        s = known.agg(F.sum(F.when(F.col("tokens") > 0, F.col("wanted"))), F.sum(F.when(F.col("wanted").isNull(), F.col("tokens")))).first()
        left = max(0.0, 1 - (s[0] or 0.0)) if s[1] else 0.0
        scale = (s[0] or 0.0) + left or 1.0
        goals[d] = materialize(known.select(d, (F.coalesce("wanted", F.lit(left) * F.col("tokens") / F.lit(s[1] or 1.0)) / scale).alias("goal")), "goal")
    now = materialize(cells.withColumn("weight", F.col("tokens") / total), "cells")
    for _ in range(steps):
        off = 0.0
        for d, goal in goals.items():
            sums = materialize(now.groupBy(d).agg(F.sum("weight").alias("sum")).join(goal, d), "sums")
            off = max(off, sums.agg(F.max(F.abs(F.col("sum") - F.col("goal")))).first()[0] or 0.0)
            scaled = now.join(sums.hint("merge"), d).withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col("goal") / F.col("sum")).otherwise(0.0))
            now = materialize(scaled.select(*now.columns), "cells")
        if off <= tolerance:
            return now
    log.warning("marginals are %.2g off after %d steps of raking", off, steps)
    return now


def fill_scale(sums_at: Callable[[float], tuple[float, float, int]], wanted: float) -> float:
    """The factor of weights at which cells, each up to all of its tokens, give ``wanted`` tokens together.

    ``sums_at(scale)``: tokens of the cells that give all they have at this scale, weight of the others, and number of the first.
    The scale only grows, and each step but the last adds a cell to the first, so it ends.
    """
    scale, before = 0.0, -1
    while True:
        full, rest, count = sums_at(scale)
        if count == before or rest <= 0:
            return scale
        scale, before = max(scale, (wanted - full) / rest), count


def calibrate(docs: DataFrame, targets: Targets, budget: float, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """(dimensions, tokens, weight, probability, shortfall) of each cell, and whether the cells are ``driver_cells`` at most.

    ``budget`` is the share of all tokens to keep. The probability is in proportion to weight per token; a cell that would have to
    give more than it has is kept whole, and the others make up for it in proportion to their weights, until the budget is met.
    ``shortfall`` is what a cell kept whole has less than its weight's share of the budget, in tokens.
    """
    dimensions = tuple(targets)
    cells = materialize(cells_of(docs, dimensions), "cells")
    few = cells.limit(driver_cells + 1).collect()
    if len(few) > driver_cells:
        raked = rake_frames(cells, targets)
    else:
        rows = sorted(tuple(r) for r in few)
        goals = []
        for d, name in enumerate(dimensions):
            present: dict[str, float] = {}
            for r in rows:
                present[r[d]] = present.get(r[d], 0.0) + r[-1]
            goals.append(full_targets(present, targets[name]))
        weights = rake(rows, goals)
        schema = ", ".join(f"`{d}` string" for d in dimensions) + ", tokens double, weight double"
        raked = docs.sparkSession.createDataFrame([(*r, w) for r, w in zip(rows, weights, strict=True)], schema)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    wanted = budget * (raked.agg(F.sum("tokens")).first()[0] or 0.0)
    if len(few) > driver_cells:

        def sums_at(scale: float) -> tuple[float, float, int]:
            whole = ratio * scale >= 1
            found = raked.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole & (F.col("tokens") > 0), F.col("weight"))), F.count_if(whole)).first()
            return found[0] or 0.0, found[1] or 0.0, found[2]
    else:

        def sums_at(scale: float) -> tuple[float, float, int]:
            whole = [w / r[-1] * scale >= 1 if r[-1] > 0 else False for r, w in zip(rows, weights, strict=True)]
            full = sum(r[-1] for r, x in zip(rows, whole, strict=True) if x)
            return full, sum(w for r, w, x in zip(rows, weights, whole, strict=True) if not x and r[-1] > 0), sum(whole)

    probability = F.when(F.col("tokens") > 0, F.least(ratio * fill_scale(sums_at, wanted), F.lit(1.0))).otherwise(F.lit(1.0))
    shortfall = F.greatest(F.col("weight") * wanted - F.col("tokens"), F.lit(0.0))
    return raked.withColumns({"probability": probability, "shortfall": shortfall}), len(few) <= driver_cells


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id (or without one on the text) and the seed only."""
    return F.pmod(F.coalesce(F.when(doc_id.isNotNull(), F.xxhash64(doc_id, F.lit(seed))), F.xxhash64(text, F.lit(seed))), F.lit(1 << 40)) / float(1 << 40)


def mix(docs: DataFrame, targets: Targets, budget: float, seed: str = SEED, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The documents of ``docs(doc_id, text, ...)`` that are sampled, with ``n_tokens``, ``topic`` and ``probability``.

    A ``topic`` column of the input is used; else it is ``topic_of`` the text. Probabilities are looked up by cell: by a
    broadcast table of ``driver_cells`` rows at most, or beyond that by a sort-merge join of two tables that adaptive execution can split.
    """
    tokens, topic, chance = (free_name(docs, n) for n in ("_tokens", "_topic", "_probability"))
    ready = docs.withColumn(tokens, token_count(F.col("text"))).withColumn(topic, F.col("topic") if "topic" in docs.columns else topic_of(F.col("text")))
    keys = {d: free_name(docs, f"_key_{d}") for d in targets}
    ready = ready.withColumns({k: F.coalesce(F.col(topic if d == "topic" else d).cast("string"), F.lit("")) for d, k in keys.items()})
    slim = ready.select(*[F.col(k).alias(d) for d, k in keys.items()], F.col(tokens).alias("n_tokens"))
    found, few = calibrate(slim, targets, budget, driver_cells)
    found = found.select(*[F.col(d).alias(k) for d, k in keys.items()], F.col("probability").alias(chance))
    found = F.broadcast(found) if few else materialize(found, "probabilities").hint("merge")
    kept = ready.join(found, list(keys.values())).where(uniform(F.col("doc_id"), F.col("text"), seed) < F.col(chance))
    added = {"n_tokens": F.col(tokens), "topic": F.col(topic), "probability": F.col(chance)}
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in added.items() if k.lower() not in {c.lower() for c in docs.columns}])

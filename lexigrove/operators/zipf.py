"""Rank-frequency analysis: term tables per condition, log-log regression, regions, curve samples, stem families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONDITIONS, condition_tokens, has_word_character, is_stop_word
from .index import postings


def condition_postings(docs: DataFrame, conditions: tuple[str, ...] = CONDITIONS[:3]) -> DataFrame:
    """(condition, doc_id, term, tf) for the conditions that need no stemmer: texts are read once, under the widest condition."""
    words = postings(docs, condition_tokens(F.col("text"), min(conditions)))
    return words.select(F.explode(_conditions_of(F.col("term"), conditions)).alias("condition"), "doc_id", "term", "tf")


def _conditions_of(term: Column, conditions: tuple[str, ...] = CONDITIONS[:3]) -> Column:
    """Under which conditions a word of condition A counts."""
    fits = {"A": F.lit(True), "B": has_word_character(term), "C": has_word_character(term) & ~is_stop_word(term)}
    return F.array_compact(F.array(*[F.when(fits[c], F.lit(c)) for c in conditions]))


def condition_table(words: DataFrame, n_docs: int | Column) -> DataFrame:
    """``term_table`` of conditions A to C from ``words(doc_id, term, tf)`` of condition A: conditions part after words are counted."""
    counts = words.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return _table(counts.select(F.explode(_conditions_of(F.col("term"))).alias("condition"), "term", "cf", "df"), n_docs)


def term_table(index: DataFrame, n_docs: int | Column) -> DataFrame:
    """(condition, rank, term, cf, df, idf, coverage) of ``index(condition, doc_id, term, tf)``, by cf, then term."""
    return _table(index.groupBy("condition", "term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")), n_docs)


def _table(counts: DataFrame, n_docs: int | Column) -> DataFrame:
    """Ranks by groups of words with one cf and beginning: groups are counted and put in order, words within each of them."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    group = ["condition", "cf", "begins"]
    placed = counts.withColumn("begins", F.substring("term", 1, 2))
    order = Window.partitionBy("condition").orderBy(F.desc("cf"), "begins").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*group).agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    within = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("term")))
    ranked = within.join(before.drop("size"), group).withColumn("rank", (F.col("before") + F.col("nth")).cast("int"))
    return ranked.select("condition", "rank", "term", "cf", "df", F.log10(n / F.col("df")).alias("idf"), (F.col("df") / n).alias("coverage"))


def totals(table: DataFrame, n_docs: int) -> DataFrame:
    """(condition, n_docs, tokens, vocabulary, avg_tokens, hapax, top_terms)."""
    return table.groupBy("condition").agg(
        F.lit(n_docs).alias("n_docs"),
        F.sum("cf").alias("tokens"),
        F.count("*").alias("vocabulary"),
        (F.sum("cf") / n_docs).alias("avg_tokens"),
        F.count_if(F.col("cf") == 1).alias("hapax"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "term")))), lambda x: x["term"]).alias("top_terms"),
    )


def fit(points: DataFrame, *keys: str, x: str = "rank", y: str = "cf") -> DataFrame:
    """(keys, n, slope, intercept, exponent, r2, rmse) of log10 y on log10 x by least squares.

    Null with fewer than two points; r2 is null where all y are equal.
    """
    logs = points.select(*keys, F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    s = logs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_slope("ly", "lx").alias("slope"),
        F.regr_intercept("ly", "lx").alias("intercept"),
        F.regr_r2("ly", "lx").alias("r2"),
        F.regr_syy("ly", "lx").alias("syy"),
        F.regr_sxx("ly", "lx").alias("sxx"),
        F.min("ly").alias("low"),
        F.max("ly").alias("high"),
    )
    some = (F.col("n") >= 2) & (F.col("sxx") > 0)
    residual = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    return s.select(
        *keys,
        "n",
        F.when(some, F.col("slope")).alias("slope"),
        F.when(some, F.col("intercept")).alias("intercept"),
        F.when(some, 0.0 - F.col("slope")).alias("exponent"),
        F.when(some & (F.col("low") < F.col("high")), F.col("r2")).alias("r2"),
        F.when(some, F.sqrt(residual / F.col("n"))).alias("rmse"),
    )


def with_region(table: DataFrame) -> DataFrame:
    """Rows with their region, head (first 5 % of ranks), middle or tail (from half on), and ``nth``, their place in it."""
    sizes = table.groupBy("condition").agg(F.count("*").alias("n"))
    n = F.col("n")
    edges = sizes.select("condition", F.greatest(F.ceil(n * 0.05), F.lit(1)).alias("head"), F.greatest(F.ceil(n * 0.5), F.lit(2)).alias("half"))
    rank = F.col("rank")
    in_head, in_middle = rank <= F.col("head"), rank <= F.col("half")
    region = F.when(in_head, "head").when(in_middle, "middle").otherwise("tail")
    start = F.when(in_head, F.lit(0)).when(in_middle, F.col("head")).otherwise(F.col("half"))
    return table.join(F.broadcast(edges), "condition").withColumn("region", region).withColumn("nth", rank - start).drop("head", "half")  # a row for each condition


def regions(table: DataFrame) -> DataFrame:
    """(condition, region, n, local fit, occurrences, global_rmse, examples)."""
    placed = with_region(table)
    whole = fit(table, "condition").select("condition", F.col("slope").alias("g_slope"), F.col("intercept").alias("g_intercept"))
    error = F.log10("cf") - (F.col("g_intercept") + F.col("g_slope") * F.log10("rank"))
    other = (
        placed.join(F.broadcast(whole), "condition")  # a row for each condition
        .groupBy("condition", "region")
        .agg(
            F.sum("cf").alias("occurrences"),
            F.sqrt(F.avg(error * error)).alias("global_rmse"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 8, F.struct("rank", "term")))), lambda x: x["term"]).alias("examples"),
        )
    )
    return fit(placed, "condition", "region").join(other, ["condition", "region"])


def curve_sample(table: DataFrame, first: int = 50, points: int = 751) -> DataFrame:
    """The first ranks and log-spaced ones after them, for a chart; the fit uses all."""
    size = table.groupBy("condition").agg(F.max("rank").alias("n"))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.round(F.pow(F.col("n").cast("double"), k / F.lit(float(points - 1)))).cast("int"))
    ranks = size.select("condition", F.explode(F.array_distinct(F.concat(spaced, F.sequence(F.lit(1), F.least(F.lit(first), F.col("n")))))).alias("rank"))
    return table.join(F.broadcast(ranks), ["condition", "rank"], "left_semi")


def stem_families(stems: DataFrame, limit: int = 20) -> DataFrame:
    """(stem, forms, cf) of stems with more than one form, from ``stems(stem, term, tf)``."""
    grouped = stems.groupBy("stem").agg(F.array_sort(F.collect_set("term")).alias("forms"), F.sum("tf").alias("cf"))
    return grouped.where(F.size("forms") > 1).orderBy(F.desc("cf"), "stem").limit(limit)


def concentrated_term(table: DataFrame) -> DataFrame:
    """(condition, widest, concentrated): the term in most documents and the one with most occurrences a document."""
    widest = F.max_by("term", F.struct("df", "cf", "term"))
    return table.groupBy("condition").agg(widest.alias("widest"), F.max_by("term", F.struct(F.col("cf") / F.col("df"), F.col("cf"), F.col("term"))).alias("concentrated"))


#: What a term table can be sorted by.
SORTS = ("rank", "term", "cf", "df", "idf", "coverage")


def sorted_terms(table: DataFrame, condition: str, by: str = "rank", descending: bool = False, part: str = "") -> DataFrame:
    """One condition's rows, sorted by a column, then by term; only terms that hold ``part``, if given."""
    if by not in SORTS:
        raise ValueError(f"a term table is sorted by {', '.join(SORTS)}")
    rows = table.where(F.col("condition") == condition)
    rows = rows.where(F.col("term").contains(part.casefold())) if part else rows
    return rows.orderBy(F.desc(by) if descending else F.asc(by), "term")

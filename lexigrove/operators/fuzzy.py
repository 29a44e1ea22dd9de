"""Edit distance, spelling suggestions and hyphen variants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.text import spelling_candidate, variant_key
from .index import postings


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance, or limit + 1 beyond the limit."""
    found = F.levenshtein(a, b, limit)
    return F.when(found < 0, F.lit(limit + 1)).otherwise(found)


def vocabulary(docs: DataFrame, words: Column) -> DataFrame:
    """(term, cf, df) of a scope."""
    return postings(docs, words).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def close_terms(queries: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Pairs (word, term, distance) with distance 1..limit: an equi-join on length, never all pairs.

    ``queries(word)`` is exploded into the lengths that a term within the limit can have.
    """
    spread = queries.withColumn("size", F.explode(F.sequence(F.greatest(F.length("word") - limit, F.lit(1)), F.length("word") + limit)))
    sized = terms.withColumn("size", F.length("term"))
    pairs = spread.join(sized, "size").withColumn("distance", F.levenshtein("word", "term", limit))
    return pairs.where(F.col("distance").between(1, limit)).drop("size")


def edit_groups(queries: DataFrame, terms: DataFrame, limit: int = 4) -> DataFrame:
    """(word, distance, rank, term, df, cf): each distance ordered by df, cf, term."""
    order = Window.partitionBy("word", "distance").orderBy(F.desc("df"), F.desc("cf"), "term")
    return close_terms(queries, terms, limit).withColumn("rank", F.row_number().over(order))


def suggest(query_words: DataFrame, terms: DataFrame, limit: int = 2) -> DataFrame:
    """(position, word, suggestion, distance, df, cf) for each word of a query, best first.

    ``query_words(position, word)`` keeps the typed form; the suggestion takes its case.
    """
    typed = query_words.withColumnRenamed("word", "typed").withColumn("word", F.lower("typed"))
    able = typed.where(spelling_candidate(F.col("word")))
    found = close_terms(able, terms.where(spelling_candidate(F.col("term"))), limit)
    upper = F.col("typed") == F.upper("typed")
    title = F.col("typed") == F.initcap("typed")
    cased = F.when(upper & (F.length("typed") > 1), F.upper("term")).when(title, F.initcap("term")).otherwise(F.col("term"))
    return found.select("position", F.col("typed").alias("word"), cased.alias("suggestion"), "distance", "df", "cf").orderBy("distance", F.desc("df"), F.desc("cf"), "suggestion", "position")


#: How long a query may be that corrections are offered for, in characters and in words.
MOST_CHARACTERS, MOST_WORDS = 512, 12


def suggest_queries(query: str, terms: DataFrame, limit: int = 2) -> DataFrame:
    """(place, corrected, distance): the query with one of its words replaced, in the case it was typed in, each outcome once.

    In order of distance, most documents, most occurrences, the alphabet, and the word's place. Longer queries have none.
    """
    from ..functions.match import token_spans

    spark = terms.sparkSession
    spans = F.when(F.length("q") <= MOST_CHARACTERS, token_spans(F.col("q")))
    typed = spark.createDataFrame([(query,)], "q string").select("q", spans.alias("spans")).where(F.size("spans") <= MOST_WORDS).select("q", F.posexplode("spans").alias("position", "s"))
    part = lambda a, b: F.substring("q", a + 1, b - a)
    asked = typed.select("position", part(F.col("s.start"), F.col("s.end")).alias("word"), part(F.lit(0), F.col("s.start")).alias("head"), part(F.col("s.end"), F.length("q")).alias("rest"))
    found = suggest(asked.select("position", "word"), terms, limit).join(asked.drop("word"), "position")  # a row for each word of a query
    order = F.struct("distance", -F.col("df"), -F.col("cf"), F.lower("suggestion"), "position")
    each = found.groupBy(F.concat("head", "suggestion", "rest").alias("corrected")).agg(F.min(order).alias("o")).where(F.col("corrected") != query)
    return each.select(F.row_number().over(Window.orderBy("o")).alias("place"), "corrected", F.col("o.distance").alias("distance"))  # outcomes for one typed query


def variant_groups(terms: DataFrame) -> DataFrame:
    """(key, variants): index terms that differ in connectors only, for keys with more than one."""
    keyed = terms.select("term", variant_key(F.col("term")).alias("key")).where("key is not null")
    grouped = keyed.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("variants"))
    return grouped.where(F.size("variants") > 1)


def expand(query_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """(group, term): each query term with the index terms that share its variant key; itself if it has no key."""
    asked = query_terms.withColumn("key", variant_key(F.col("term")))
    keyed = terms.select(F.col("term").alias("variant"), variant_key(F.col("term")).alias("key"))
    by_key = asked.where("key is not null").join(keyed, "key").select(F.col("term").alias("group"), F.col("variant").alias("term"))
    return by_key.union(asked.select(F.col("term").alias("group"), "term")).distinct()


def alignment(a: str, b: str) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The edit-distance table and one best path from its end to its start: diagonal first, then up, then left."""
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(table[-1][j - 1] + (x != y), table[-1][j] + 1, row[-1] + 1))
        table.append(row)
    at, path = (len(a), len(b)), [(len(a), len(b))]
    while at != (0, 0):
        i, j = at
        steps = [(i - 1, j - 1, (i and j and a[i - 1] != b[j - 1]) or 0), (i - 1, j, 1), (i, j - 1, 1)]
        at = next((p, q) for p, q, cost in steps if p >= 0 and q >= 0 and table[p][q] + cost == table[i][j])
        path.append(at)
    return table, path[::-1]


def with_alignment(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``distance``, ``table`` and ``path``."""
    ship(pairs.sparkSession)

    @F.pandas_udf("table array<array<int>>, path array<struct<i: int, j: int>>")
    def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [alignment(x or "", y or "") for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"table": [t for t, _ in found], "path": [[{"i": i, "j": j} for i, j in p] for _, p in found]})

    out = pairs.withColumn("_x", aligned("a", "b")).select("*", "_x.table", "_x.path").drop("_x")
    return out.withColumn("distance", F.element_at(F.element_at("table", -1), -1))

"""CSV abstracts, identifiers, duplicate lookup, and CSV/JSON/ZIP-free exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe

#: Fixed value of the import contract: the form of an identifier, new (year and month, number) or old (archive, number).
ARXIV = r"^(?:\d{4}\.\d{4,5}|[a-zA-Z.-]+/\d{7})$"
MOST_ROWS, MOST_BYTES = 1000, 20 << 20


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(row, id, title, abstract, error) of a CSV with headers id, title, abstract; a bad row says what is wrong with it."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a CSV has {MOST_BYTES} bytes at most, this one {size}")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    missing = {"id", "title", "abstract"} - {c.lstrip("\ufeff") for c in raw.columns}
    if missing:
        raise ValueError(f"the CSV lacks the columns {sorted(missing)}")
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    if not 1 <= raw.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        raise ValueError(f"a CSV has 1 to {MOST_ROWS} rows")
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ident = F.regexp_replace(F.regexp_replace(clean("id"), "^https://arxiv\\.org/abs/", ""), r"v\d+$", "")
    error = F.when(~ident.rlike(ARXIV), "no identifier of a known form").when(clean("title") == "", "no title").when(clean("abstract") == "", "no abstract")
    # a small file is one partition, so its rows are numbered as they stand, the header being row 1
    return raw.coalesce(1).select((F.monotonically_increasing_id() + 2).alias("row"), ident.alias("id"), clean("title").alias("title"), clean("abstract").alias("abstract"), error.alias("error"))


def import_outcome(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One row: new, reused, errors; the first row of an unknown id is new."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    good = rows.where("error is null").withColumn("nth", nth).join(known.select("id", F.lit(True).alias("there")), "id", "left")
    fresh = good.agg(F.count_if(F.col("there").isNull() & (F.col("nth") == 1)).alias("new"), F.count_if(F.col("there").isNotNull() | (F.col("nth") > 1)).alias("reused"))
    return fresh.crossJoin(rows.agg(F.count("error").alias("errors")))


def identifier_kind(text: Column) -> Column:
    """struct<kind, id>: pmc or pubmed; kind null if it is neither."""
    x = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.struct(
        F.when(x.rlike(r"^PMC\d+$"), "pmc").when(x.rlike(r"^(?:PMID:?)?\d+$"), "pubmed").alias("kind"),
        F.when(x.rlike(r"^PMC\d+$"), x).otherwise(F.regexp_replace(x, "^PMID:?", "")).alias("id"),
    )


def identifier_list(text: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.filter(F.split(text, r"[\s,;]+"), lambda x: x != "")), 1, most)


def duplicate_keys(rows: DataFrame, title: str = "title", file: str = "source_file") -> DataFrame:
    """(rows' columns, kind, key, priority): what a record can be recognised by, the surest first."""
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    stable = (value("pmcid") != "") | (value("pmid") != "") | (value("doi") != "") | (value("arxiv_id") != "")
    loose = lambda c: F.when(~stable, F.lower(c)).otherwise(F.lit(""))
    keys = [value("arxiv_id"), F.lower(value("pmcid")), F.lower(value("pmid")), F.lower(value("doi")), loose(value(file)), loose(value(title))]
    kinds = ("arxiv", "pmcid", "pmid", "doi", "file", "title")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key"), F.lit(p).alias("priority")) for p, (k, v) in enumerate(zip(kinds, keys, strict=True))])
    return rows.withColumn("k", F.explode(F.filter(each, lambda x: x["key"] != ""))).select(*rows.columns, "k.*")


def find_duplicates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(incoming_id, doc_id, kind): the document that each incoming record is a copy of; one equi-join over all kinds of keys.

    Titles count only with equal years, unless the incoming record has none.
    """
    new = duplicate_keys(incoming).select("incoming_id", "kind", "key", "priority", F.coalesce("publication_year", F.lit("")).alias("year"))
    old = _all_keys(existing)
    pairs = new.join(old, ["kind", "key"]).where((F.col("kind") != "title") | (F.col("year") == "") | (F.col("year") == F.col("old_year")))
    best = pairs.groupBy("incoming_id").agg(F.min_by(F.struct("doc_id", "kind"), F.struct("priority", "doc_id")).alias("b"))
    return best.select("incoming_id", "b.doc_id", "b.kind")


def _all_keys(existing: DataFrame) -> DataFrame:
    """Existing documents can be found by file and title, too, whatever ids they have."""
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    keys = [("arxiv", value("arxiv_id")), *[(k, F.lower(value(k))) for k in ("pmcid", "pmid", "doi")], ("file", F.lower(value("source_file"))), ("title", F.lower(value("title")))]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys])
    return existing.select("doc_id", F.coalesce("publication_year", F.lit("")).alias("old_year"), F.explode(F.filter(each, lambda x: x["key"] != "")).alias("k")).select("doc_id", "old_year", "k.*")


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema])


def guarded(rows: DataFrame) -> DataFrame:
    """Text columns made safe for spreadsheets."""
    return rows.select(*[csv_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema])


def write_csv(rows: DataFrame, path: str, digits: int = 6, bom: bool = False) -> None:
    """A folder of CSV files with headers; doubles rounded, nested columns as JSON; with ``bom`` a byte order mark before the header."""
    flat = rows.select(*[F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name) for f in rows.schema])
    safe = guarded(rounded(flat, digits))
    if bom:  # spreadsheets read UTF-8 by it; it stands before the first column's name, in every part
        safe = safe.withColumnRenamed(safe.columns[0], "\ufeff" + safe.columns[0])
    safe.write.mode("overwrite").option("header", True).csv(path)


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV under its name, and as JSON lines beside it: the report bundles."""
    for name, rows in tables.items():
        write_csv(rows, f"{folder}/{name}.csv")
        rounded(rows).write.mode("overwrite").json(f"{folder}/{name}.json")


def write_vectors(words: DataFrame, path: str) -> None:
    """word2vec's text format without its first line: a word and its components."""
    words.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x.cast("double"))), " "))).write.mode("overwrite").text(path)

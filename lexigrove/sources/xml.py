"""Article XML (PubMed and JATS): one parse per file gives a flat list of nodes; everything else is expressions on it."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

NODES = "array<struct<i: int, last: int, depth: int, tag: string, path: string, kind: string, text: string, own: string, tail: string>>"

#: Tags whose text is taken, and the attributes that tell kinds of a tag apart.
TAGS = frozenset(
    "ArticleTitle AbstractText Keyword PMID ArticleId Title Year MedlineDate ForeName LastName CollectiveName Language DescriptorName QualifierName "
    "article-title abstract title p sec kwd article-id journal-title year surname given-names body id summary published name totalResults".split()
)
KINDS = ("abstract-type", "IdType", "pub-id-type", "contrib-type", "MajorTopicYN", "date-type")

#: Abstract types that are no main abstract.
EXCLUDED_ABSTRACTS = "toc editor graphical teaser short lay plain-language-summary lay-summary layperson".split()
LABEL = r"(?i)\bkeywords?\s*:"

RECORD = ("title", "raw_text", "pmcid", "pmid", "arxiv_id", "doi", "journal", "publication_year", "authors", "abstract")


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def flat_nodes(content: bytes | str | None) -> list[dict] | None:
    """The nodes of a document in order, each with its text, its place and the last node below it; None if it can't be parsed."""
    try:
        root = ET.fromstring(content or b"")
    except ET.ParseError:
        return None
    out: list[dict] = []

    def visit(node: ET.Element, depth: int, path: str) -> None:
        tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else "#"
        mine = {"i": len(out), "last": 0, "depth": depth, "tag": tag, "path": path + "/" + tag}
        mine["kind"] = next((node.attrib[k].strip() for k in KINDS if k in node.attrib), "")
        mine["text"] = _squeeze("".join(node.itertext())) if tag in TAGS else ""
        mine["own"], mine["tail"] = _squeeze(node.text or ""), _squeeze(node.tail or "")
        out.append(mine)
        for child in node:
            visit(child, depth + 1, mine["path"])
        mine["last"] = len(out) - 1

    visit(root, 0, "")
    return out


def nodes(content: Column) -> Column:
    @F.pandas_udf(NODES)
    def parsed(column: pd.Series) -> pd.Series:
        return column.map(flat_nodes, na_action=None)

    return parsed(content)


def texts(found: Column, tag: str, under: str = "/") -> Column:
    """Non-empty texts of nodes with a tag below a path part, in document order."""
    return F.filter(F.transform(F.filter(found, lambda n: (n["tag"] == tag) & n["path"].contains(under)), lambda n: n["text"]), lambda t: t != "")


def first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def up_to_keywords(parts: Column) -> Column:
    """The parts up to the first that holds a keyword label."""
    at = F.array_position(F.transform(parts, lambda p: p.rlike(LABEL)), F.lit(True))
    return F.when(at > 0, F.slice(parts, 1, at.cast("int"))).otherwise(parts)


def with_keywords(abstract: Column, keywords: Column) -> Column:
    """The abstract with one line of keywords, unless it has one already."""
    line = F.when((F.size(keywords) > 0) & ~abstract.rlike(LABEL), F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws("\n\n", F.nullif(abstract, F.lit("")), line)


def below(found: Column, top: Column) -> Column:
    return F.filter(found, lambda n: (n["i"] > top["i"]) & (n["i"] <= top["last"]))


def main_abstract(found: Column) -> Column:
    """The abstract node to read: untyped, else typed normal, else the first of a type that is not excluded."""
    all_ = F.filter(found, lambda n: (n["tag"] == "abstract") & n["path"].contains("/article-meta/"))
    kind = lambda n: F.lower(n["kind"])
    choices = [F.filter(all_, lambda n: n["kind"] == ""), F.filter(all_, lambda n: kind(n) == "normal"), F.filter(all_, lambda n: ~kind(n).isin(EXCLUDED_ABSTRACTS))]
    return F.coalesce(*[F.get(c, F.lit(0)) for c in choices])


def jats_abstract(found: Column, top: Column) -> Column:
    """Paragraphs of the abstract node ``top``, parted by blank lines and without headings; its other text if it has none."""
    inside = below(found, top)
    line = F.filter(inside, lambda n: n["tag"].isin("title", "p"))
    heading = lambda n: (n["tag"] == "title") & n["text"].rlike(r"(?i)^keywords?\s*:?\s*$")

    def read(n: Column, i: Column) -> Column:
        before = F.get(line, i - 1)
        pending = (i > 0) & F.coalesce(heading(before), F.lit(False))
        return F.when(n["tag"] == "p", F.when(pending & (n["text"] != "") & ~n["text"].rlike(LABEL), F.concat(F.lit("Keywords: "), n["text"])).otherwise(n["text"])).otherwise(F.lit(""))

    paragraphs = F.filter(F.transform(line, read), lambda t: t != "")
    children = F.filter(inside, lambda n: n["depth"] == top["depth"] + 1)
    pieces = F.concat(F.array(top["own"]), F.flatten(F.transform(children, lambda n: F.array(F.when(n["tag"] == "title", "").otherwise(n["text"]), n["tail"]))))
    loose = F.array_join(up_to_keywords(F.filter(pieces, lambda t: t != "")), " ")
    text = F.when(F.size(paragraphs) > 0, F.array_join(up_to_keywords(paragraphs), "\n\n")).otherwise(loose)
    return F.when(top.isNotNull(), text).otherwise(F.lit(""))


def article_id(found: Column, tag: str, kind: str) -> Column:
    return first(F.transform(F.filter(found, lambda n: (n["tag"] == tag) & (F.lower(n["kind"]) == kind)), lambda n: n["text"]))


def author_names(found: Column, tag: str, given: str, family: str, collective: str | None = None, kind: str | None = None) -> Column:
    people = F.filter(found, lambda n: (n["tag"] == tag) & ((n["kind"] == kind) if kind else F.lit(True)))

    def name(person: Column) -> Column:
        inside = below(found, person)
        pick = lambda t: F.nullif(first(texts(inside, t)), F.lit(""))
        plain = F.concat_ws(" ", pick(given), pick(family))
        return F.coalesce(pick(collective), plain) if collective else plain

    return F.array_join(F.filter(F.transform(people, name), lambda x: x != ""), ", ")


def pubmed_year(found: Column) -> Column:
    dates = [first(texts(found, "Year", f"/{p}/")) for p in ("ArticleDate", "PubDate", "DateCompleted", "DateRevised")]
    return first_filled(*dates, F.regexp_extract(first(texts(found, "MedlineDate")), r"\b((?:19|20)\d{2})\b", 1))


def pubmed_columns(found: Column, file: Column) -> dict[str, Column]:
    abstract = with_keywords(F.array_join(up_to_keywords(texts(found, "AbstractText")), "\n\n"), texts(found, "Keyword", "/MedlineCitation/"))
    return {
        "title": first_filled(first(texts(found, "ArticleTitle")), file),
        "raw_text": abstract,
        "pmcid": article_id(found, "ArticleId", "pmc"),
        "pmid": first(texts(found, "PMID")),
        "arxiv_id": article_id(found, "ArticleId", "arxiv"),
        "doi": article_id(found, "ArticleId", "doi"),
        "journal": first(texts(found, "Title", "/Journal/")),
        "publication_year": pubmed_year(found),
        "authors": author_names(found, "Author", "ForeName", "LastName", "CollectiveName"),
        "abstract": abstract,
    }


def body_text(found: Column) -> Column:
    """Titles and paragraphs of the body, parted by blank lines; the body's whole text if it has none."""
    blocks = F.transform(F.filter(found, lambda n: n["tag"].isin("title", "p") & n["path"].contains("/body/")), lambda n: n["text"])
    return first_filled(F.array_join(F.filter(blocks, lambda t: t != ""), "\n\n"), first(texts(found, "body")))


def jats_columns(found: Column, file: Column) -> dict[str, Column]:
    abstract = with_keywords(jats_abstract(found, main_abstract(found)), texts(found, "kwd", "/article-meta/"))
    body = body_text(found)
    return {
        "title": first_filled(first(texts(found, "article-title")), file),
        "raw_text": F.concat_ws("\n\n", F.nullif(abstract, F.lit("")), F.nullif(body, F.lit(""))),
        "pmcid": first_filled(*[article_id(found, "article-id", k) for k in ("pmcid", "pmcaid", "pmc")]),
        "pmid": article_id(found, "article-id", "pmid"),
        "arxiv_id": article_id(found, "article-id", "arxiv"),
        "doi": article_id(found, "article-id", "doi"),
        "journal": first(texts(found, "journal-title")),
        "publication_year": first_filled(first(texts(found, "year", "/pub-date/")), first(texts(found, "year"))),
        "authors": author_names(found, "contrib", "given-names", "surname", kind="author"),
        "abstract": abstract,
    }


def parse_articles(files: DataFrame) -> DataFrame:
    """``files(path, content)`` as records: ``RECORD`` with source_file; files that are not XML or give no text are left out."""
    ship(files.sparkSession)
    name = F.element_at(F.split("path", "/"), -1)
    parsed = files.where(F.lower("path").endswith(".xml")).select(name.alias("source_file"), nodes(F.col("content")).alias("nodes")).where("nodes is not null")
    found = F.col("nodes")
    is_pubmed = F.exists(found, lambda n: n["tag"] == "PubmedArticle")
    a, b = pubmed_columns(found, F.col("source_file")), jats_columns(found, F.col("source_file"))
    columns = [F.when(is_pubmed, a[c]).otherwise(b[c]).alias(c) for c in RECORD]
    return parsed.select("source_file", *columns).where("raw_text <> ''")


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of a folder of .xml files, by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select("path", "content")
    return parse_articles(files).orderBy("source_file")


def headings(files: DataFrame) -> DataFrame:
    """(path, descriptor, major, qualifiers) of each MeSH heading: major if the descriptor or a qualifier is flagged."""
    ship(files.sparkSession)
    parsed = files.select("path", nodes(F.col("content")).alias("nodes")).where("nodes is not null")
    tops = F.filter("nodes", lambda n: n["tag"] == "MeshHeading")

    def heading(top: Column) -> Column:
        inside = below(F.col("nodes"), top)
        named = F.filter(inside, lambda n: n["tag"].isin("DescriptorName", "QualifierName"))
        return F.struct(
            first(texts(inside, "DescriptorName")).alias("descriptor"),
            F.exists(named, lambda n: n["kind"] == "Y").alias("major"),
            texts(inside, "QualifierName").alias("qualifiers"),
        )

    return parsed.select("path", F.explode(F.transform(tops, heading)).alias("h")).select("path", "h.*").where("descriptor <> ''")


def parse_feed(files: DataFrame) -> DataFrame:
    """(arxiv_id, title, abstract, publication_year, authors) of the entries of Atom feeds; version suffixes are dropped."""
    ship(files.sparkSession)
    parsed = files.select(nodes(F.col("content")).alias("nodes")).where("nodes is not null")
    entries = F.filter("nodes", lambda n: n["tag"] == "entry")

    def entry(top: Column) -> Column:
        inside = below(F.col("nodes"), top)
        return F.struct(
            F.regexp_replace(F.regexp_replace(first(texts(inside, "id")), "^https?://arxiv\\.org/abs/", ""), "v\\d+$", "").alias("arxiv_id"),
            first(texts(inside, "title")).alias("title"),
            first(texts(inside, "summary")).alias("abstract"),
            F.substring(first(texts(inside, "published")), 1, 4).alias("publication_year"),
            F.array_join(texts(inside, "name", "/author/"), ", ").alias("authors"),
        )

    return parsed.select(F.explode(F.transform(entries, entry)).alias("e")).select("e.*")

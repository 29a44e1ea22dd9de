"""SGML newswire: stories, split membership, and the same extraction on HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORY = r"(?s)<REUTERS[^>]*>.*?</REUTERS>"
SPLITS = ("modapte", "modlewis", "modhayes")
#: HTML entities that occur in the sources.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for name, plain in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def element(story: Column, tag: str) -> Column:
    """The text of the first element of a tag, unescaped and trimmed; empty if there is none."""
    return F.regexp_replace(unescape(F.regexp_extract(story, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), r"^\s+|\s+$", "")


def attribute(story: Column, name: str) -> Column:
    return F.regexp_extract(story, rf'^<REUTERS[^>]*\b{name}="([^"]*)"', 1)


def clean_body(text: Column) -> Column:
    """Without control characters and the agency's name at the end."""
    plain = F.regexp_replace(F.replace(text, F.lit("\u0003"), F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?i)\s*\bReuter\s*$", ""), r"^\s+|\s+$", "")


def split_of(rule: str, topics: Column, lewis: Column, cgi: Column) -> Column:
    """train, test or unused under one of ``SPLITS``."""
    if rule == "modhayes":
        return F.when(cgi == "TRAINING-SET", "train").when(cgi == "PUBLISHED-TESTSET", "test").otherwise("unused")
    part = F.when(lewis == "TRAIN", "train").when(lewis == "TEST", "test").otherwise("unused")
    return F.when(topics == "YES" if rule == "modapte" else topics != "BYPASS", part).otherwise("unused")


def parse_stories(files: DataFrame) -> DataFrame:
    """(id, splits, attrs, topics, date, title, body) of each story in ``files(content binary)``."""
    raw = files.select(F.explode(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(STORY), F.lit(0))).alias("s"))
    s = F.col("s")
    attrs = {k: attribute(s, k) for k in ("TOPICS", "LEWISSPLIT", "CGISPLIT")}
    topics = F.regexp_extract_all(F.regexp_extract(s, r"(?s)<TOPICS>(.*?)</TOPICS>", 1), F.lit("<D>(.*?)</D>"), F.lit(1))
    splits = [x for rule in SPLITS for x in (F.lit(rule), split_of(rule, *attrs.values()))]
    return raw.select(
        attribute(s, "NEWID").cast("int").alias("id"),
        F.create_map(*splits).alias("splits"),
        F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)]).alias("attrs"),
        topics.alias("topics"),
        F.substring(element(s, "DATE"), 1, 11).alias("date"),
        element(s, "TITLE").alias("title"),
        clean_body(element(s, "BODY")).alias("body"),
    )


def load_stories(spark: SparkSession, folder: str) -> DataFrame:
    return parse_stories(spark.read.format("binaryFile").option("pathGlobFilter", "*.sgm").load(folder).select("content"))


def partition_of(stories: DataFrame, split: str, part: str) -> DataFrame:
    return stories.where(F.col("splits")[split] == part)


def story(stories: DataFrame, number: int) -> DataFrame:
    return stories.where(F.col("id") == number)


def split_counts(stories: DataFrame) -> DataFrame:
    """(split, train, test, unused)."""
    return stories.select(F.explode("splits").alias("split", "part")).groupBy("split").pivot("part", ["train", "test", "unused"]).count().na.fill(0)


def search_text(title: Column, body: Column) -> Column:
    return F.regexp_replace(F.concat_ws("\n", title, body), r"^\s+|\s+$", "")


def page_elements(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, n_links, first_link) of HTML pages."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select(
        "page_id",
        unescape(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(html, r'<html lang="([^"]*)"', 1).alias("lang"),
        F.size(links).alias("n_links"),
        F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"),
    )

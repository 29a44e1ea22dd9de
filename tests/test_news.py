import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import match, text, unicode
from lexigrove.functions import sentences as sent
from lexigrove.operators import news, skipgram, vectors
from lexigrove.plans import catalogue
from lexigrove.sources import xml


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_highlight(spark):
    wanted = match.Wanted(("hiv1", "virus"))
    text = "HIV-1 & <virus>, 20-25 viral"
    assert one(spark, match.highlight(F.col("t"), wanted), t=text) == "<mark>HIV-1</mark> &amp; &lt;<mark>virus</mark>&gt;, 20-25 viral"
    assert one(spark, match.highlight(F.col("t"), wanted, first=F.lit(4)), t=text).startswith('<mark id="match-5">HIV-1</mark> &amp; &lt;<mark id="match-6">virus</mark>')
    assert one(spark, match.match_count(F.col("t"), wanted), t=text) == 2
    assert one(spark, match.first_match(F.col("t"), wanted), t="é " + text) == 2
    spans = one(spark, match.token_spans(F.col("t")), t="é 20-25")
    assert [tuple(s) for s in spans] == [(0, 1, "é"), (2, 4, "20"), (5, 7, "25")]
    assert one(spark, match.highlight_term(F.col("t"), ",", "A"), t="a, b") == "a<mark>,</mark> b"
    assert one(spark, match.highlight_term(F.col("t"), "b", "B"), t="A b B. bb") == "A <mark>b</mark> <mark>B</mark>. bb"
    assert one(spark, match.highlight_term(F.col("t"), "run", "D", ("runs", "running")), t="run runs running") == "run <mark>runs</mark> <mark>running</mark>"
    assert one(spark, match.lead(F.col("t"), 3), t="abcdef") == "abc…"
    assert one(spark, match.paragraphs(F.col("t")), t="a\nb\n    c") == ["a b", "c"]


def test_unicode(spark):
    assert unicode.canonical("é") == "é" and unicode.canonical("Straße", fold=True) == unicode.canonical("STRASSE", fold=True)
    assert one(spark, unicode.normalized(F.col("t"), "NFKC"), t="Ａ") == "A"


def test_condition_sentences(spark):
    assert one(spark, sent.condition_sentences(F.col("t"), "C"), t="The ship left. Good. It was late today.") == [["ship", "left"], ["late", "today"]]


def test_feed(spark):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1907.00042v5</id><title>T
 x</title><summary>S</summary><published>2024-01-01T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author></entry></feed>"""
    row = xml.parse_feed(spark.createDataFrame([("f", bytearray(feed.encode()))], "path string, content binary")).first()
    assert tuple(row) == ("1907.00042", "T x", "S", "2024", "A B, C")


def test_news_methods(spark):
    stories = spark.createDataFrame([(1, "Oil", "crude oil rose", ["crude"]), (2, "Wheat", "wheat harvest", ["grain"]), (3, "", "12", [])], "id int, title string, body string, topics array<string>")
    words, docs = news.news_index(stories)
    n = docs.count()
    vectors_ = spark.createDataFrame([("oil", [1.0, 0.0]), ("crude", [1.0, 0.1]), ("petroleum", [0.9, 0.1]), ("wheat", [0.0, 1.0])], "word string, vec array<double>")
    queries = spark.createDataFrame([("q", "petroleum", 1), ("q", "oil", 1)], "query_id string, term string, tf long")
    found = news.rankings(news.method_scores(words, queries, vectors_, n))
    best = {r["method"]: r["doc_id"] for r in found.where("rank = 1").collect()}
    assert best == dict.fromkeys(news.METHODS, 1)
    assert found.where("method = 'embedding_mean'").count() == 2 and found.where("method = 'tfidf'").count() == 1
    seen = {r["term"]: (r["in_collection"], r["has_vector"], r["idf"]) for r in news.diagnostics(queries, words, vectors_, n).collect()}
    assert seen["petroleum"] == (False, True, pytest.approx(0.477121, abs=1e-6)) and seen["oil"][0]
    assert {r["topic"]: r["n"] for r in news.topic_overview(stories).collect()} == {"crude": 1, "grain": 1, None: 1}
    assert news.result_rows(found, stories, "crude").where("method = 'tfidf'").first()["relevant"]
    stats = news.training_stats(spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "c"])], "doc_id long, words array<string>")).first()
    assert (stats["n_docs"], stats["n_sentences"], stats["n_tokens"], stats["vocabulary"], stats["top_words"]) == (1, 2, 4, 3, ["a", "b", "c"])


def test_seven_methods_and_their_evaluation(spark):
    stories = spark.createDataFrame([(1, "Oil", "crude oil rose", ["crude"]), (2, "Wheat", "wheat harvest", ["grain"])], "id int, title string, body string, topics array<string>")
    words, docs = news.news_index(stories)
    model = spark.createDataFrame([("oil", [1.0, 0.0]), ("crude", [1.0, 0.1]), ("wheat", [0.0, 1.0])], "word string, vec array<double>")
    queries = spark.createDataFrame([("q", "oil", 1)], "query_id string, term string, tf long")
    found = news.rankings(news.all_method_scores(words, queries, {"cbow": model, "skipgram": model}, docs.count()))
    assert len({r["method"] for r in found.collect()}) == 7
    kinds = spark.createDataFrame([("q", "keyword", "crude")], "query_id string, type string, topic string")
    rows = news.evaluate(found, stories, kinds).collect()
    assert {r["level"] for r in rows} == {"all", "type", "topic"} and len(rows) == 21 and all(r["rr"] == 1 for r in rows)


ODD = ["The U.S. ship left. It sank, e.g. on 20-25 May! Dr. Wu’s «Straße» K-9 ﬁsh.\nNew line 3.5% İstanbul ΣΑΣ.  ", "", None, "a\u0001bc de.  Fgh ijk?", "One. Two. Oil oil oil\r\n\r\nwheat.", "J. K. Rowling wrote it.” No. 5 is here. x", "!!! 12 34.", "Kelvin K rose. Price fell 1990-91-92 – up."]


def test_words_and_sentences_come_from_one_pass(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string")
    for r in rows.select("t", sent.news_words(F.col("t")).alias("w"), sent.news_sentences(F.col("t")).alias("s"), text.news_tokens(F.col("t")).alias("all")).collect():
        assert [w for w in r["w"] if w != sent.BREAK] == r["all"], r["t"]
        parts = [p.split() for p in " ".join(r["w"]).split(sent.BREAK)]
        assert [p for p in parts if len(p) >= 2] == r["s"], r["t"]


def test_scores_of_a_corpus_are_those_of_its_postings(spark):
    stories = spark.createDataFrame([(k // 2 if k > 6 else k, "T", t, ["x"]) for k, t in enumerate(ODD * 2)], "id int, title string, body string, topics array<string>")
    index, docs = news.news_index(stories)
    n = docs.count()
    model = spark.createDataFrame([("oil", [1.0, 0.1]), ("wheat", [0.3, -1.0]), ("ship", [0.0, 0.7]), ("rowling", [0.0, 0.0])], "word string, vec array<double>")
    queries = spark.createDataFrame([("q", "oil", 2), ("q", "sank", 1), ("q", "oil", 1), ("r", "rowling", 1), ("r", "absent", 1), ("s", "wheat", 1)], "query_id string, term string, tf long")
    words = news.story_words(stories).cache()
    counts = skipgram.word_counts(words, 2)
    assert {r["word"]: r["df"] for r in counts.collect()} == {r["term"]: r["count"] for r in index.groupBy("term").count().collect()}
    found = news.corpus_scores(news.document_sums(words, counts, model, queries, n), counts, model, queries, n)
    keyed = lambda df: {(r["query_id"], r["method"], r["doc_id"]): r["score"] for r in df.collect()}
    assert keyed(found) == pytest.approx(keyed(news.method_scores(index, queries, model, n)), abs=1e-12)


def test_skip_gram_tells_topics_apart_and_keeps_rare_words_out(spark):
    rng = random.Random(7)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    rows = [([w for _ in range(6) for w in [*rng.choices(topics[k % 3], k=8), sent.BREAK]],) for k in range(600)] + [(["rare", "a1", "a2"],)] * 4 + [(["lone"],)] * 9
    found = {r["word"]: r["vec"] for r in vectors.skip_gram(spark.createDataFrame(rows, "words array<string>").repartition(4), size=8, epochs=2, least=2).collect()}
    assert set(found) == {w for t in topics for w in t}
    a, b = ([cosine(found[x], found[y]) for x in found for y in found if x < y and (x[0] == y[0]) == same] for same in (True, False))
    assert sum(a) / len(a) > sum(b) / len(b) + 0.5


def cosine(x, y):
    dot = lambda p, q: sum(i * j for i, j in zip(p, q, strict=True))
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


@pytest.mark.parametrize("name", ["news_evaluation", "news_methods"])
def test_methods_read_texts_once(spark, name):
    """Texts are cut into words once for training, postings and vectors (each had its own pass, some several)."""
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.count() == {"news_evaluation": 28, "news_methods": 160}[name]
    leaves = found._jdf.queryExecution().sparkPlan().collectLeaves()
    assert not [leaf for k in range(leaves.size()) if "text" in (leaf := leaves.apply(k).output().toString())]

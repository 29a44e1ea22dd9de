import math

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import match
from lexigrove.functions import text as tx
from lexigrove.operators import evaluation, index, ranking, reports, scope, zipf

TEXTS = {1: "Copper rose. Tin fell again! Copper, see Fig. 2 of it.", 2: "Tin and lead.", 3: "Zinc <b> copper", 4: None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def words_of(docs):
    return index.postings(docs, tx.weighting_tokens(F.col("text")))


def test_article_detail(docs):
    rows = reports.article_detail(docs, 1, match.Wanted(("copper", "tin"))).orderBy("place").collect()
    assert [(r["place"], r["matches"]) for r in rows] == [(0, 1), (1, 1), (2, 1)]
    assert [r["sentence"] for r in rows] == ['<mark id="match-1">Copper</mark> rose.', '<mark id="match-2">Tin</mark> fell again!', '<mark id="match-3">Copper</mark>, see Fig. 2 of it.']
    assert reports.article_detail(docs, 4, match.Wanted(("x",))).count() == 0 and reports.article_detail(docs, 99, match.Wanted(("x",))).count() == 0


def test_display_stats(docs):
    found = {r["doc_id"]: (r["words"], r["characters"], r["sentences"]) for r in reports.display_stats(docs).collect()}
    assert found == {1: (11, 54, 3), 2: (3, 13, 1), 3: (3, 15, 1), 4: (0, 0, 0)}


def test_story_detail_and_queries(spark):
    stories = spark.createDataFrame([(7, "Ore", {"modapte": "test"}, ["tin"]), (8, "Sea", {"modapte": "train"}, [])], "id int, title string, splits map<string,string>, topics array<string>")
    rankings = spark.createDataFrame([("tfidf", 7, 2), ("hybrid", 7, 1), ("tfidf", 8, 1)], "method string, doc_id long, rank int")
    words = spark.createDataFrame([(7, "tin", 3), (7, "ore", 1), (8, "sea", 1), (8, "ore", 1)], "doc_id long, term string, tf long")
    r = reports.story_detail(stories, rankings, words, 7, "tin").first()
    assert (r["title"], r["relevant"], r["ranks"], r["terms"]) == ("Ore", True, {"tfidf": 2, "hybrid": 1}, ["tin", "ore"])
    queries = spark.createDataFrame([("q2", "tin", "tin price"), ("q1", "tin", "tin mines"), ("q3", "sea", "tide")], "query_id string, topic string, text string")
    keywords = spark.createDataFrame([("tin", 2, "mine"), ("tin", 1, "ore")], "topic string, rank int, term string")
    found = {r["topic"]: ([q["query_id"] for q in r["queries"]], r["keywords"]) for r in reports.queries_by_topic(queries, keywords).collect()}
    assert found == {"tin": (["q1", "q2"], ["ore", "mine"]), "sea": (["q3"], None)}
    shown = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "method string, relevant boolean")
    assert {r["method"]: r["hits"] for r in reports.hits_at(shown).collect()} == {"a": 1, "b": 0}


def test_index_is_rebuilt_and_replaced(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    words = tx.weighting_tokens(F.col("text"))
    reports.write_index(docs, words, path)
    read = lambda: {tuple(r) for r in spark.read.parquet(path).collect()}
    assert read() == {tuple(r) for r in index.stored_postings(docs, words).collect()}
    changed = spark.createDataFrame([(2, "Silver"), (3, "Gold")], "doc_id long, text string")
    reports.write_index(changed, words, path, changed.where("doc_id = 2").select("doc_id"))
    assert {t for d, t, _ in read() if d == 2} == {"silver"} and {t for d, t, _ in read() if d == 3} == {"zinc", "b", "copper"}
    links = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, topic string")
    left = reports.delete_cascade(spark.createDataFrame([(1,)], "doc_id long"), docs, links, spark.read.parquet(path))
    assert [t.where("doc_id = 1").count() for t in left] == [0, 0, 0] and [t.count() > 0 for t in left] == [True] * 3


def test_bundles(spark, docs, tmp_path):
    table = zipf.condition_table(index.postings(docs, tx.condition_tokens(F.col("text"), "A")), 3).cache()
    bundle = reports.zipf_bundle(table, 3, docs, {"conditions": ["A", "B", "C"]})
    from lexigrove.sources.tables import export_tables

    export_tables(bundle, str(tmp_path / "zipf"))
    assert spark.read.option("header", True).csv(str(tmp_path / "zipf/summary.csv")).count() == 3
    assert spark.read.json(str(tmp_path / "zipf/methodology.json")).first()["value"] == '["A", "B", "C"]'
    domains = reports.domain_bundle({"one": table, "two": table.where("cf > 1")})
    assert {r["jaccard"] <= 1 for r in domains["overlap"].collect()} == {True} and domains["totals"].count() == 6
    words = words_of(docs)
    queries = spark.createDataFrame([("q", "copper", 1)], "query_id string, term string, tf long")
    ranked = ranking.ranked(ranking.vector_scores(words, queries), "query_id", "method")
    qrels = spark.createDataFrame([("q", 3, 1)], "query_id string, doc_id long, grade int")
    per = evaluation.metrics(ranked, qrels, 10, "method")
    report = reports.report_bundle(words, per)
    assert report["tfidf"].where("term = 'copper' and doc_id = 1").first()["tfidf"] == pytest.approx(2 * math.log10(3 / 2))
    assert report["evaluation"].where("query_id = 'MEAN'").count() == 6
    dump = reports.experiment_bundle(per, ranked, qrels)
    assert set(dump) == {"per_query", "means", "best", "rankings", "qrels"} and dump["means"].count() == 6
    reports.write_evaluation(per, str(tmp_path / "evaluation"))
    assert spark.read.option("header", True).csv(str(tmp_path / "evaluation")).count() == 12
    reports.write_model_bundle(spark.createDataFrame([("tin", [0.5, 1.0])], "word string, vec array<double>"), {"losses": per}, str(tmp_path / "model"))
    assert spark.read.text(str(tmp_path / "model/vectors.txt")).first()[0] == "tin 0.500000 1.000000"


def test_models_are_kept(spark, docs, tmp_path):
    store, trained = reports.ModelStore(spark, f"file://{tmp_path}/models"), []

    def train(rows, settings):
        trained.append(settings)
        return spark.createDataFrame([("tin", [1.0])], "word string, vec array<double>")

    first, second = reports.Settings(), reports.Settings(epochs=6)
    assert [store.get(docs, s, train)[1] for s in (first, first, second)] == [False, True, False] and trained == [first, second]
    assert store.get(docs.where("doc_id < 3"), first, train)[1] is False
    for bad in ({"size": 1}, {"window": 30}, {"condition": "E"}, {"architecture": "x"}, {"epochs": 0}):
        with pytest.raises(ValueError):
            reports.Settings(**bad)


def test_both_architectures_train(spark):
    rows = spark.createDataFrame([(k, "Copper ore is mined. Copper wire is drawn. Green tea is brewed.") for k in range(30)], "doc_id long, text string")
    for name in ("cbow", "skipgram"):
        found = reports.train_model(rows, reports.Settings(name, size=4, epochs=2, min_count=1))
        assert {"copper", "tea"} <= {r["word"] for r in found.collect()} and len(found.first()["vec"]) == 4
    sets = {"half": rows.where("doc_id < 15"), "all": rows}
    sentences = {k: v.select(F.split(F.lower("text"), r"[ .]+").alias("words")) for k, v in sets.items()}
    out = reports.ablation(sentences, lambda m: m.agg(F.count("*").alias("n")), reports.Settings(size=4, epochs=1, min_count=1))
    assert {r["corpus"] for r in out.collect()} == {"half", "all"}


def test_samples_and_selections(spark, docs):
    rows = spark.createDataFrame([(k, "medical" if k % 3 else "cs") for k in range(90)], "doc_id long, domain string")
    balanced = scope.preset_sample(rows, "balanced")
    assert {r["class"]: r["n"] for r in scope.class_counts(balanced).collect()} == {"medical": 30, "cs": 30}
    assert {r["class"]: r["n"] for r in scope.class_counts(scope.preset_sample(rows, "custom", custom={"cs": 4})).collect()} == {"cs": 4}
    assert scope.preset_sample(rows, "all").count() == 90 and scope.preset_sample(rows, "cs").count() == 30
    with pytest.raises(ValueError, match="preset"):
        scope.preset_sample(rows, "none")
    bridge = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "doc_id long, topic_id int")
    topics = spark.createDataFrame([(5, "tin"), (6, "ore")], "topic_id int, name string")
    assert {r["doc_id"]: r["topics"] for r in scope.topics_of_documents(docs, bridge, topics).collect()} == {1: ["ore", "tin"], 2: ["tin"], 3: [], 4: []}


def test_hashes_depend_on_every_text(spark, docs):
    import hashlib

    want = hashlib.sha256("".join(f"{k}\0{t or ''}\0" for k, t in sorted(TEXTS.items())).encode()).hexdigest()
    assert scope.content_hash(docs).first()[0] == scope.content_hash(docs.repartition(3)).first()[0] == want
    tree = scope.tree_hash(docs).first()[0]
    assert tree == scope.tree_hash(docs.repartition(3)).first()[0] != scope.tree_hash(docs.where("doc_id < 4")).first()[0]


def test_filters(spark):
    docs = spark.createDataFrame(
        [(1, "Body.", "9", "", "Tin ORE", ["h"]), (2, "Body.\n\nKeywords: a", "", "", "x", []), (3, "Keywords: a", "8", "", "x", ["h"]), (4, "Body.", "7", "2001.00001", "x", ["h"]), (5, "\n\nKeywords: a", "6", None, "x", ["h"])],
        "doc_id long, abstract string, pmid string, arxiv_id string, title string, headings array<string>",
    )
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert ids(scope.importable(docs)) == [1, 2, 4] and ids(scope.importable(docs, True)) == [1, 4]
    assert ids(scope.corpus_scope(docs)) == [1, 3, 5] and ids(scope.title_contains(docs, "in or")) == [1]
    topics = docs.withColumn("topics", F.col("headings"))
    assert ids(scope.has_topic(topics, "h")) == [1, 3, 4, 5] and ids(scope.has_topic(topics, None)) == [2]
    assert [r["d"] for r in docs.orderBy("doc_id").select(scope.domain(F.col("arxiv_id")).alias("d")).collect()] == ["medical"] * 3 + ["cs", "medical"]
    assert [r["doc_id"] for r in scope.ordered(docs.withColumn("publication_year", F.col("pmid")), "newest").collect()] == [1, 3, 4, 5, 2]


def test_reading_view(spark):
    text = "Title of part\n\nOne is here. Two is\nhere.\n\n\nOther part\n\nThree. Four!"
    rows = reports.reading_view(spark.createDataFrame([(1, text), (2, None)], "doc_id long, raw_text string")).orderBy("block", "number").collect()
    assert [(r["block"], r["kind"], r["number"], r["sentence"]) for r in rows] == [(0, "section", None, "Title of part"), (1, "paragraph", 1, "One is here."), (1, "paragraph", 2, "Two is here."), (2, "section", None, "Other part"), (3, "paragraph", 3, "Three."), (3, "paragraph", 4, "Four!")]


def test_document_stats(docs):
    found = {r["doc_id"]: (r["characters_no_space"], r["words_per_sentence"]) for r in reports.document_stats(docs).collect()}
    assert found == {1: (44, 3.67), 2: (11, 3.0), 3: (13, 3.0), 4: (0, 0.0)}


def test_corrected_query(spark):
    from lexigrove.operators import fuzzy

    terms = spark.createDataFrame([("copper", 9, 5), ("cooper", 1, 1), ("smelter", 3, 2)], "term string, cf long, df long")
    offered = lambda q: [r["corrected"] for r in fuzzy.suggest_queries(q, terms).orderBy("place").collect()]
    assert offered("old Coper, smelter") == ["old Copper, smelter", "old Cooper, smelter"]
    assert offered("SMELTRE copper") == ["SMELTRE cooper", "SMELTER copper"]
    assert offered("qqqqqq the") == offered("coper " * 13) == offered("coper " + "x" * 600) == []


def test_orders(spark, docs):
    scores = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 2.0)], "doc_id long, score double")
    titles = spark.createDataFrame([(1, "b"), (2, "c"), (3, "A")], "doc_id long, title string")
    assert [r["doc_id"] for r in ranking.by_title(scores, titles).collect()] == [2, 3, 1]
    first, second = (spark.createDataFrame([("q", d, k + 1) for k, d in enumerate(ids)], "query_id string, doc_id long, rank int") for ids in ([1, 2, 3], [3, 4]))
    assert {(r["side"], r["doc_id"], r["rank"], r["other_rank"]) for r in ranking.other_ranks(first, second, 2).collect()} == {("first", 1, 1, None), ("first", 2, 2, None), ("second", 3, 1, 3), ("second", 4, 2, None)}
    table = zipf.condition_table(index.postings(docs, tx.condition_tokens(F.col("text"), "A")), 3)
    assert [r["term"] for r in zipf.sorted_terms(table, "C", "cf", True, "IN").collect()] == ["tin", "again", "zinc"]
    with pytest.raises(ValueError, match="sorted"):
        zipf.sorted_terms(table, "C", "x")
    assert {r["term"] for r in index.weighting_postings(docs, stop_words=False, stem=True).where("doc_id = 2").collect()} == {"tin", "and", "lead"}

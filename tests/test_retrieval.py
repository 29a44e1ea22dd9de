import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as tx
from lexigrove.operators import evaluation, fuzzy, index, ranking, scope, vectors, weighting, zipf

DOCS = [(1, "iron zinc zinc zinc"), (2, "iron lead"), (3, "lead lead zinc"), (4, "iron iron cobalt"), (5, "lead cobalt cobalt cobalt cobalt")]
IDF3, IDF2 = math.log10(5 / 3), math.log10(5 / 2)


@pytest.fixture(scope="module")
def words(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return index.postings(docs, tx.weighting_tokens(F.col("text"))).cache()


def test_term_stats(words):
    found = {r["term"]: r for r in index.term_stats(words).collect()}
    assert {t: (r["df"], r["cf"]) for t, r in found.items()} == {"iron": (3, 4), "zinc": (2, 4), "lead": (3, 4), "cobalt": (2, 5)}
    assert found["iron"]["idf"] == pytest.approx(IDF3) and found["cobalt"]["idf"] == pytest.approx(IDF2)


def weights_of(words, method, doc):
    rows = weighting.document_weights(weighting.with_stats(words), (method,)).where(F.col("doc_id") == doc).collect()
    return {r["term"]: pytest.approx(r["weight"]) for r in rows}


def test_weights(words):
    assert weights_of(words, "log_tf", 1) == {"iron": 1, "zinc": 1 + math.log10(3)}
    assert weights_of(words, "idf", 4) == {"iron": IDF3, "cobalt": IDF2}
    assert weights_of(words, "tfidf", 1) == {"iron": IDF3, "zinc": 3 * IDF2}
    assert weights_of(words, "logtfidf", 3) == {"lead": (1 + math.log10(2)) * IDF3, "zinc": IDF2}


def asked(spark, *terms):
    return spark.createDataFrame([("q", t, 1) for t in terms], "query_id string, term string, tf long")


def test_cosine_and_dot(spark, words):
    rows = ranking.ranked(ranking.vector_scores(words, asked(spark, "zinc", "lead"), ("raw_tf",), True), "query_id", "method").orderBy("rank").collect()
    want = {3: 3 / math.sqrt(10), 1: 3 / math.sqrt(20), 2: 0.5, 5: 1 / math.sqrt(34)}
    assert [(r["doc_id"], r["score"]) for r in rows] == [(d, pytest.approx(x)) for d, x in want.items()]
    dots = {r["doc_id"]: r["score"] for r in ranking.vector_scores(words, asked(spark, "lead"), ("raw_tf",)).collect()}
    assert dots == {2: 1.0, 3: 2.0, 5: 1.0}
    one = {r["doc_id"]: r["score"] for r in ranking.vector_scores(words, asked(spark, "zinc"), ("tfidf",), True).collect()}
    assert one[1] == pytest.approx(3 * IDF2 / math.hypot(IDF3, 3 * IDF2))


def test_ranking_ties(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.0), (2, 0.9), (3, 0.5)], "doc_id long, score double")
    assert [r["doc_id"] for r in ranking.ranked(scores).orderBy("rank").collect()] == [2, 0, 3]


def test_metrics(spark):
    grades = [1, 0, 2, 0, 0, 1, 0]
    qrels = spark.createDataFrame([("q", d, g) for d, g in enumerate(grades)], "query_id string, doc_id long, grade int")
    order = [1, 2, 6, 0, 5, 3, 4]
    rows = spark.createDataFrame([("q", d, r + 1) for r, d in enumerate(order)], "query_id string, doc_id long, rank int")
    m = evaluation.metrics(rows, qrels).first()
    assert (m["p5"], m["p"], m["recall"], m["rr"]) == (0.6, 0.3, 1.0, 0.5)
    gain = 3 / math.log2(3) + 1 / math.log2(5) + 1 / math.log2(6)
    assert m["ndcg"] == pytest.approx(gain / (3 + 1 / math.log2(3) + 1 / math.log2(4)))
    ideal = spark.createDataFrame([("q", d, r + 1) for r, d in enumerate([2, 0, 5, 1, 3, 4, 6])], "query_id string, doc_id long, rank int")
    assert evaluation.metrics(ideal, qrels).first()["ndcg"] == pytest.approx(1.0)


def test_heading_grades(spark):
    heads = spark.createDataFrame([(1, "Rivers", True, []), (2, "Lakes", False, ["history"])], "doc_id long, descriptor string, major boolean, qualifiers array<string>")
    rules = spark.createDataFrame([("q", "descriptor", "Rivers"), ("q", "qualifier", "history")], "query_id string, kind string, value string")
    assert {r["doc_id"]: r["grade"] for r in evaluation.heading_grades(heads, rules).collect()} == {1: 2, 2: 1}


def test_zipf_fit(spark):
    table = spark.createDataFrame([("A", r, 500.0 / r**2) for r in range(1, 41)], "condition string, rank int, cf double")
    f = zipf.fit(table, "condition").first()
    assert (f["exponent"], f["intercept"], f["r2"], f["rmse"]) == pytest.approx((2, math.log10(500), 1, 0), abs=1e-6)
    flat = zipf.fit(spark.createDataFrame([("A", r, 5.0) for r in (1, 2, 3)], "condition string, rank int, cf double"), "condition").first()
    assert flat["r2"] is None and flat["slope"] == pytest.approx(0)
    assert zipf.fit(spark.createDataFrame([("A", 1, 5.0)], "condition string, rank int, cf double"), "condition").first()["slope"] is None


def test_ranks_of_words(spark):
    """Ranks by groups are those of one sort; conditions part after counting as they do before it."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "and", ".", "a1", "b", "bb", "bba", "é", "éa", "x-y", "7", "zoo"]) for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = zipf.condition_table(index.postings(docs, tx.condition_tokens(F.col("text"), "A")), 30).collect()
    slow = zipf.term_table(zipf.condition_postings(docs), 30).collect()
    assert sorted(found) == sorted(slow)
    for c in "ABC":
        rows = sorted((r for r in found if r["condition"] == c), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert rows == sorted(rows, key=lambda r: (-r["cf"], r["term"].encode()))
    regions = {(r["condition"], r["region"]): r for r in zipf.regions(spark.createDataFrame(found)).collect()}
    whole = [r["term"] for r in sorted((r for r in found if r["condition"] == "A"), key=lambda r: r["rank"])]
    assert [t for k in ("head", "middle", "tail") for t in regions["A", k]["examples"]] == whole


def test_bm25_search_and_fallback(spark, words):
    lengths = index.doc_lengths(words).select("doc_id", "length")
    groups = spark.createDataFrame([("zinc", "zinc")], "term string, group string")
    found = ranking.top(ranking.bm25_scores(words, lengths, groups), 5).collect()
    n, df, avg = 5, 2, 17 / 5
    want = math.log((n - df + 0.5) / (df + 0.5) + 1) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / avg))
    assert found[0]["doc_id"] == 1 and found[0]["score"] == pytest.approx(want)
    both = ranking.all_terms_scores(words, ["iron", "zinc"]).collect()
    assert [(r["doc_id"], r["score"]) for r in both] == [(1, 4.0)]


def test_variants_search_as_one_word(spark):
    docs = spark.createDataFrame([(1, "x-ray image"), (2, "xray xray"), (3, "x‑ray image and XRAY"), (4, "ray")], "doc_id long, text string")
    words_ = index.postings(docs, tx.tokens(F.col("text")))
    groups = ranking.variant_groups_of(["xray", "won't"], words_.select("term").distinct())
    lengths = index.doc_lengths(words_).select("doc_id", "length")
    found = {r["doc_id"]: r["matched"] for r in ranking.bm25_scores(words_, lengths, groups).collect()}
    assert found == {1: ["xray"], 2: ["xray"], 3: ["xray"]}
    assert {r["group"]: r["variants"] for r in ranking.variants_present(groups, words_).collect()} == {"xray": ["x-ray", "x‑ray"]}


def test_distances(spark):
    pairs = spark.createDataFrame([("gardens", "pardon", 3), ("", "xy", 2), ("on", "no", 2)], "a string, b string, want int")
    for r in fuzzy.with_alignment(pairs).collect():
        assert r["distance"] == r["want"] and r["path"][0] == (0, 0) and tuple(r["path"][-1]) == (len(r["a"]), len(r["b"]))
    assert pairs.select(fuzzy.bounded_distance(F.col("a"), F.col("b"), 2).alias("d")).first()["d"] == 3


def test_suggestions(spark):
    terms = spark.createDataFrame([("planet", 5, 3), ("planes", 1, 1), ("über", 2, 2), ("the", 9, 9)], "term string, cf long, df long")
    words_ = spark.createDataFrame([(0, "PLANAT"), (1, "the"), (2, "zzzzzz"), (3, "Ubér")], "position int, word string")
    found = fuzzy.suggest(words_, terms).collect()
    assert [(r["word"], r["suggestion"], r["distance"]) for r in found] == [("PLANAT", "PLANET", 1), ("Ubér", "Über", 2)] + [("PLANAT", "PLANES", 2)] or {(r["word"], r["suggestion"], r["distance"]) for r in found} == {("PLANAT", "PLANET", 1), ("PLANAT", "PLANES", 2), ("Ubér", "Über", 2)}
    expanded = fuzzy.expand(spark.createDataFrame([("hiv1",)], "term string"), spark.createDataFrame([("hiv-1",), ("hiv2",)], "term string"))
    assert {r["term"] for r in expanded.collect()} == {"hiv1", "hiv-1"}


def test_edit_groups_against_brute_force(spark):
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("aäbcéß-") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    rows = fuzzy.edit_groups(spark.createDataFrame([("aäb",), ("é",)], "word string"), spark.createDataFrame([(t, 1, 1) for t in terms], "term string, cf long, df long"), 2).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    assert {(r["word"], r["term"], r["distance"]) for r in rows} == {(w, t, distance(w, t)) for w in ("aäb", "é") for t in terms if 1 <= distance(w, t) <= 2}


def test_scope(spark):
    docs = spark.createDataFrame([(i, "2024") for i in (1, 2, 3, 4)], "doc_id long, publication_year string")
    bridge = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 20)], "doc_id long, topic_id int")
    assert scope.in_topics(docs, bridge, [10, 20]).count() == 3
    assert scope.in_topics(docs, bridge, []).count() == 4
    years = spark.createDataFrame([("2021",), ("2024",), ("n.d.",), (" ",)], "publication_year string")
    assert [r["year"] for r in scope.years(years).collect()] == ["2024", "2021", "n.d."]
    halves = spark.createDataFrame([(i, i < 4, i > 1) for i in range(6)], "doc_id long, a boolean, b boolean")
    out = scope.split_domains(halves, F.col("a"), F.col("b"))
    assert {r["domain"]: r["count"] for r in out.groupBy("domain").count().collect()} == {"a": 2, "b": 2}


def test_vectors(spark):
    words_ = spark.createDataFrame([("tin", [1.0, 0.0, 0.0]), ("ore", [0.0, 1.0, 0.0])], "word string, vec array<double>")
    weights = spark.createDataFrame([(1, "tin", 3.0), (1, "ore", 1.0), (1, "unknown", 5.0), (2, "tin", 0.0)], "doc_id long, term string, weight double")
    assert [(r["doc_id"], r["vec"]) for r in vectors.document_vectors(None, words_, weights).collect()] == [(1, [0.75, 0.25, 0.0])]
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()["c"] == 0
    windows = vectors.context_windows(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), F.split("text", " "), 1)
    assert [r["context"] for r in windows.orderBy("at").collect()] == [["b"], ["a", "c"], ["b"]]
    pairs = vectors.semantic_pairs(words_.union(spark.createDataFrame([("zinc", [1.0, 1.0, 0.0])], words_.schema)), spark.createDataFrame([("tin",), ("ore",), ("zinc",), ("gold",)], "word string")).collect()
    assert [(r["first"], r["second"]) for r in pairs] == [("ore", "zinc"), ("tin", "zinc"), ("ore", "tin")]
    typed = vectors.target_words(" Tin, ore ore\nZINC", words_)
    assert [r["word"] for r in typed.collect()] == ["tin"] and vectors.target_words(" ", words_, ("ore",)).count() == 1
    assert {r["word"] for r in vectors.shared_vocabulary(words_, spark.createDataFrame([("ore",), ("lead",)], "word string")).collect()} == {"ore"}


def test_training_examples():
    ids, owner = np.array([0, 1, 2, 3]), np.array([0, 0, 0, 1])
    inputs, targets = vectors.training_examples(ids, owner, 1, "cbow")
    assert inputs.tolist() == [[-1, 1], [0, 2], [1, -1]] and targets.tolist() == [0, 1, 2]
    inputs, targets = vectors.training_examples(ids, owner, 2, "skipgram")
    assert sorted(zip(inputs[:, 0].tolist(), targets.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


@pytest.mark.parametrize("mode", ["cbow", "skipgram"])
@pytest.mark.parametrize("negatives", [0, 4])
def test_networks_learn(mode, negatives):
    rng = random.Random(2)
    sentences = [[rng.choice(["red", "blue"]), rng.choice(["car", "bus"]), "drives"] if k % 2 else [rng.choice(["hot", "cold"]), rng.choice(["soup", "tea"]), "boils"] for k in range(200)]
    words_, found, losses = vectors.train_network(sentences, vectors.Network(mode, epochs=40, negatives=negatives, rate=0.2))
    assert words_ == sorted(words_) and len(losses) == 40 and losses[-1] < 0.95 * losses[0]
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    like = lambda a, b: unit[words_.index(a)] @ unit[words_.index(b)]
    assert like("car", "bus") > like("car", "tea") and like("soup", "tea") > like("soup", "bus")


def test_full_softmax_gradient():
    """One step of a batch of one follows the derivative of the loss."""
    how = vectors.Network("cbow", size=3, window=1, epochs=1, rate=1e-6, batch=1)
    words_, first, losses = vectors.train_network([["a", "b"]], how)
    assert words_ == ["a", "b"] and losses[0] == pytest.approx(math.log(2), abs=1e-4) and np.abs(first).max() <= 0.5 / 3 + 1e-6
    with pytest.raises(ValueError, match="trained"):
        vectors.Network("other")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    empty = index.postings(none, tx.tokens(F.col("text")))
    assert index.term_stats(empty).count() == 0
    assert index.corpus_summary(empty).first()["n_docs"] == 0
    assert ranking.vector_scores(empty, spark.createDataFrame([("q", "x", 1)], "query_id string, term string, tf long")).count() == 0

import pytest
from pyspark.sql import functions as F

from lexigrove.sources import newswire, tables, xml
from lexigrove.streaming.ingest import Corpus, import_folder

PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>87</PMID><Article><Journal><Title>Annals of Tides</Title><JournalIssue><PubDate><Year>2019</Year></PubDate></JournalIssue></Journal>
<ArticleTitle>Moon and <i>water</i></ArticleTitle><Abstract><AbstractText>Opening words.</AbstractText><AbstractText>Closing words.</AbstractText></Abstract>
<AuthorList><Author><LastName>Ruiz</LastName><ForeName>Ana</ForeName></Author><Author><CollectiveName>Harbour Board</CollectiveName></Author></AuthorList></Article>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="N">Oceans</DescriptorName><QualifierName MajorTopicYN="Y">statistics</QualifierName></MeshHeading></MeshHeadingList>
<KeywordList><Keyword>tide</Keyword><Keyword>pier</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.77/t</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""
JATS = """<article><front><article-meta><article-id pub-id-type="pmc">PMC55</article-id><title-group><article-title>Harbours</article-title></title-group>
<abstract abstract-type="toc"><p>For the list only.</p></abstract><abstract><sec><title>Aim</title><p>We measured <b>waves</b> daily.</p></sec></abstract>
<kwd-group><kwd>storm surge</kwd><kwd>λ wave</kwd></kwd-group></article-meta></front><body><sec><title>Methods</title><p>Buoys were read.</p></sec></body></article>"""
KEYED = JATS.replace("</sec></abstract>", "<title>Keywords</title><p>sand, mud</p><p>left out</p></sec></abstract>")


def files(spark, **texts):
    return spark.createDataFrame([(f"/in/{k}.xml", bytearray(v.encode())) for k, v in texts.items()], "path string, content binary")


def test_articles(spark):
    found = {r["source_file"]: r for r in xml.parse_articles(files(spark, p=PUBMED, j=JATS, k=KEYED, bad="<a>")).collect()}
    assert set(found) == {"p.xml", "j.xml", "k.xml"}
    p = found["p.xml"]
    assert (p["title"], p["pmid"], p["doi"], p["journal"], p["publication_year"], p["authors"]) == ("Moon and water", "87", "10.77/t", "Annals of Tides", "2019", "Ana Ruiz, Harbour Board")
    assert p["abstract"] == "Opening words.\n\nClosing words.\n\nKeywords: tide, pier"
    assert found["j.xml"]["abstract"] == "We measured waves daily.\n\nKeywords: storm surge, λ wave"
    assert found["j.xml"]["raw_text"].endswith("Methods\n\nBuoys were read.") and found["j.xml"]["pmcid"] == "PMC55"
    assert found["k.xml"]["abstract"] == "We measured waves daily.\n\nKeywords: sand, mud"


def test_headings(spark):
    h = xml.headings(files(spark, p=PUBMED)).first()
    assert (h["descriptor"], h["major"], h["qualifiers"]) == ("Oceans", True, ["statistics"])


SGML = """<REUTERS TOPICS="NO" LEWISSPLIT="TEST" CGISPLIT="TRAINING-SET" OLDID="31" NEWID="802"><DATE> 3-MAR-1987 09:30</DATE><TOPICS><D>copper</D><D>freight</D></TOPICS>
<TEXT><TITLE>MINES &lt;MN></TITLE><BODY>Mines &lt;north&gt; shipped 40 pct more.
 Reuter \x03</BODY></TEXT></REUTERS><REUTERS TOPICS="YES" LEWISSPLIT="NOT-USED" CGISPLIT="PUBLISHED-TESTSET" NEWID="803"><BODY>none</BODY></REUTERS>
<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN" CGISPLIT="OTHER" NEWID="804"></REUTERS>"""


def test_newswire(spark):
    stories = newswire.parse_stories(spark.createDataFrame([(bytearray(SGML.encode("latin-1")),)], "content binary"))
    rows = stories.orderBy("id").collect()
    assert rows[0]["topics"] == ["copper", "freight"] and rows[0]["body"] == "Mines <north> shipped 40 pct more." and rows[0]["title"] == "MINES <MN>"
    assert rows[0]["splits"] == {"modapte": "unused", "modlewis": "test", "modhayes": "train"}
    assert rows[1]["splits"] == {"modapte": "unused", "modlewis": "unused", "modhayes": "test"} and rows[1]["topics"] == []
    assert rows[2]["splits"] == {"modapte": "train", "modlewis": "train", "modhayes": "unused"} and rows[2]["body"] == ""
    assert newswire.partition_of(stories, "modlewis", "test").count() == 1
    assert {r["split"]: (r["train"], r["test"], r["unused"]) for r in newswire.split_counts(stories).collect()} == {"modapte": (1, 0, 2), "modlewis": (1, 1, 1), "modhayes": (1, 1, 1)}


def test_csv(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.csv"
    path.write_text("\ufeffid,title,abstract\n1907.00042v3,One,Text\n1907.00042,One,\"Two\nlines\"\nhep-th/9901001,Old,Text\nnowhere,T,A\n1907.00043,,A\n1907.00044,T,\n", encoding="utf-8")
    rows = tables.read_abstracts(spark, str(path))
    found = rows.orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(2, 8)) and [r["error"] for r in found] == [None, None, None, "no identifier of a known form", "no title", "no abstract"]
    out = tables.import_outcome(rows, spark.createDataFrame([("hep-th/9901001",)], "id string")).first()
    assert (out["new"], out["reused"], out["errors"]) == (1, 2, 3)
    monkeypatch.setattr(tables, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="10 bytes"):
        tables.read_abstracts(spark, str(path))


def test_duplicates(spark):
    schema = "doc_id long, arxiv_id string, pmcid string, pmid string, doi string, source_file string, title string, publication_year string"
    old = spark.createDataFrame([(1, "", "PMC9", "", "", "a.xml", "Tides", "2019"), (2, "", "", "77", "", "b.xml", "Waves", "2020"), (3, "1907.00042", "", "", "10.1/x", "c.xml", "Sand", "2021")], schema)
    new = spark.createDataFrame(
        [(10, "", "pmc9", "77", "", "", "", ""), (11, "", "", "", "10.1/X", "a.xml", "Tides", "2019"), (12, "", "", "", "", "B.xml", "", ""), (13, "", "", "", "", "", "WAVES", "2020"), (14, "", "", "", "", "", "waves", "1999"), (15, "", "", "", "", "", "sand", "")], schema
    ).withColumnRenamed("doc_id", "incoming_id")
    assert {r["incoming_id"]: (r["doc_id"], r["kind"]) for r in tables.find_duplicates(new, old).collect()} == {10: (1, "pmcid"), 11: (3, "doi"), 12: (2, "file"), 13: (2, "title"), 15: (3, "title")}


def test_identifiers(spark):
    ids = spark.createDataFrame([("pmc 31",), ("PMID:8",), ("4",), ("q5",)], "t string").select(tables.identifier_kind(F.col("t")).alias("k")).collect()
    assert [(r["k"]["kind"], r["k"]["id"]) for r in ids] == [("pmc", "PMC31"), ("pubmed", "8"), ("pubmed", "4"), (None, "Q5")]
    assert spark.range(1).select(tables.identifier_list(F.lit("a, b;a\nc")).alias("x")).first()["x"] == ["a", "b", "c"]


def test_export(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("=x", 1 / 3, [1])], "a string, b double, c array<int>"), str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().asDict() == {"a": "'=x", "b": "0.333333", "c": "[1]"}
    tables.write_csv(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "b"), bom=True)
    assert "\ufeffa\né\n".encode() in [f.read_bytes() for f in (tmp_path / "b").glob("*.csv")]


def test_import(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "p.xml").write_text(PUBMED)
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    import_folder(spark, f"file://{source}", corpus, "first", str(tmp_path / "state")).awaitTermination()
    assert corpus.documents().count() == 1
    (source / "p2.xml").write_text(PUBMED.replace("Opening words", "Other words"))
    (source / "j.xml").write_text(JATS)
    import_folder(spark, f"file://{source}", corpus, "second", str(tmp_path / "state")).awaitTermination()
    assert corpus.documents().count() == 2
    assert {(r["topic"]) for r in corpus.links().collect()} == {"first", "second"} and corpus.links().count() == 3
    assert corpus.postings().where("term = 'opening'").count() == 1

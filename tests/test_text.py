import re

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import sentences as sent
from lexigrove.functions import text as tx
from lexigrove.functions.spans import match_spans, replace_spans
from lexigrove.functions.stem import stem, stem_terms


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


CASES = {
    "Vitamin-B12 AK-47 MiG-29's dog's i.v. 7.25% 3.5": "vitamin-b12 ak-47 mig-29's dog's i.v. 7.25% 3.5",
    "salt/pepper": "salt pepper",
    "7-9%": "7 9%",
    "7–9%": "7 9%",
    "HR 1.25, range: 0.31–0.88": "hr 1.25 range 0.31 0.88",
    "two-fold two‐fold two‑fold two–fold": "two-fold two‐fold two‑fold two–fold",
    "Hodgkin's D’Arcy tests—mostly": "hodgkin's d’arcy tests mostly",
    "a.k.a. N.Y. Ω λ κ Kir2ΩΣ/ΣΩΣ": "a.k.a. n.y. ω λ κ kir2ωσ σωσ",
    "36.6kg 7%z 4-q": "36 6kg 7 z 4-q",
    "Gauß STRASSE İzmir \u212aelvin": "gauss strasse i\u0307zmir kelvin",
    "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_tokens(spark, text):
    assert one(spark, tx.tokens(F.col("t")), t=text) == CASES[text].split()


def test_conditions(spark):
    assert one(spark, tx.tokens_and_marks(F.col("t")), t="HIV-1 fell. 0.25") == ["hiv-1", "fell", ".", "0.25"]
    assert one(spark, tx.condition_tokens(F.col("t"), "B"), t="HIV-1 fell. 0.25") == ["hiv-1", "fell", "0.25"]
    assert one(spark, tx.condition_tokens(F.col("t"), "C"), t="Those fell and 7-9") == ["fell", "7", "9"]
    assert one(spark, tx.tokens_and_marks(F.col("t")), t="7-9") == ["7", "-", "9"]
    assert one(spark, tx.weighting_tokens(F.col("t")), t="An AK-47 rifle, or AK‑47 copies!") == ["ak-47", "rifle", "ak-47", "copies"]
    assert one(spark, tx.news_tokens(F.col("t")), t="A bank cut rates 25 bps to 4.5 pct") == "bank cut rates bps pct".split()
    assert len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 72 and sorted(tx.STOP_WORDS) == tx.STOP_WORDS


def test_folding(spark):
    texts = ["ﬁn ﬀ ŉx ſ ẞ ΑΣ ǰ µ K İ Straße ΐ ᏸ ﬓ", "plain TEXT", "", "ᾳ ᾼ ẘ"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.casefold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in out] == [t.casefold() for t in texts]
    assert all(one(spark, tx.tokens(F.col("t")), t=t) == one(spark, F.transform(F.regexp_extract_all(F.col("t"), F.lit(tx.TOKEN), F.lit(0)), tx.casefold), t=t) for t in texts)


def test_null_text(spark):
    assert one(spark, tx.tokens(F.col("t").cast("string")), t=None) == []
    assert one(spark, sent.sentences(F.col("t").cast("string")), t=None) == []


SENTENCES = {
    "Prof. Lindgren spoke. They listened.": 2,
    "Compare Eq. 4 and i.e. that. Done": 2,
    "K. Jensen paid 2.50. It was cheap!": 2,
    "She said \"go.\" Then it rained.": 2,
    "First line\nSecond line": 2,
    "Plan B. Next one.": 1,
    "plan b. next one": 2,
    "Is it? Yes! 好。对": 3,
    "": 0,
}


@pytest.mark.parametrize("text", SENTENCES)
def test_sentences(spark, text):
    assert one(spark, sent.sentence_count(F.col("t")), t=text) == SENTENCES[text]


STEMS = {"sky": "sky", "flies": "fli",
         "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file",
         "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper", "triplicate": "triplic", "electriciti": "electr", "revival": "reviv",
         "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll", "is": "is", "news": "news", "dying": "die"}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    rows = spark.createDataFrame([(1, "engines", 2), (1, "engine", 1)], "doc_id long, term string, tf long")
    assert {r["stem"] for r in stem_terms(rows).collect()} == {"engin"}


def test_scalars(spark):
    assert one(spark, tx.variant_key(F.col("t")), t="HIV‑2") == "hiv2"
    assert one(spark, tx.variant_key(F.col("t")), t="won't") is None
    assert one(spark, tx.csv_safe(F.col("t")), t=" =1+1") == "' =1+1"
    assert one(spark, tx.csv_safe(F.col("t")), t="a=1") == "a=1"
    assert one(spark, tx.index_text(F.col("t")), t="Keyword : x; y") == "  x; y"
    assert one(spark, tx.topic_key(F.col("t")), t="  Steel \n Prices ") == "steel prices"
    assert one(spark, tx.is_blank(F.col("t")), t="\t ") is True
    assert one(spark, tx.escape_html(F.col("t")), t="<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, tx.snippet(F.col("t"), F.lit(10), 5, 8), t="abcdefghijklmnopqrstuvwxyz") == "…fghijklm…"


def test_spans_are_placed_in_one_pass(spark):
    texts = ["", "a1b22", "é1😀22x333", "ab12 " * 700 + "é9", "12" * 3, "0123456789abcdef ok " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    spans = match_spans(F.col("text"), "[0-9]+")
    for r in df.select("text", spans.alias("spans"), replace_spans(F.col("text"), spans, "#").alias("new")).collect():
        assert [tuple(s) for s in r["spans"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r["text"])]
        assert r["new"] == re.sub("[0-9]+", "#", r["text"])


def test_overlapping_spans_become_one_mark(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 4), (2, 3), (3, 6), (6, 7), (9, 9))])
    assert spark.range(1).select(replace_spans(F.lit("0123456789"), spans, "#")).first()[0] == "0##78#9"

"""Lemmas by affix rules, and signals over them."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.dates import annotate_dates
from chronoweave.functions.lemmas import forms, lemma
from chronoweave.functions.tokens import lemma_model, tokenizer
from chronoweave.operators import signals

KNOWN = signals.lemmas_of(signals.KEYWORDS)


@pytest.mark.parametrize("word, base", [
    ("follows", "follow"), ("Followed", "follow"), ("cities", "city"), ("carried", "carry"), ("stopped", "stop"), ("making", "make"), ("beginning", "begin"), ("began", "begin"), ("opened", "open"),
    ("is", "be"), ("churches", "church"), ("houses", "house"), ("string", "string"), ("red", "red"), ("need", "need"), ("during", "during"), ("this", "this"), ("moved", "move"), ("created", "create"),
    ("finished", "finish"), ("status", "status"), ("glass", "glass"), ("2nd", "2nd"), ("", ""), ("added", "add"), ("telling", "tell"), ("ended", "end"), ("preceding", "precede"),
])
def test_lemma(word, base):
    assert lemma(word) == base


def test_nouns_and_known_lemmas():
    assert lemma("ending", "the") == "ending" and lemma("ending", "was") == "end"
    assert lemma("basing") == "base" and lemma("basing", known={"bas"}) == "bas"


def test_forms_are_the_words_with_that_lemma():
    for base in ("begin", "precede", "start", "carry", "stop", "time", "be"):
        assert base in forms(base, KNOWN) and all(lemma(w, known=KNOWN) == base for w in forms(base, KNOWN))
    assert {"begins", "began", "begun", "beginning"} <= set(forms("begin", KNOWN))
    assert forms("finished", KNOWN) == [] and forms("during", KNOWN) == ["during"]


def _said(spark, texts, keywords=None):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", annotate_dates(F.col("t")))
    given = tokenizer(lemma_model(signals.lemmas_of(keywords or signals.KEYWORDS)))(F.col("t"))
    rows = rows.withColumn("k", given)
    both = rows.select("i", signals.explicit_expressions(F.col("t"), F.col("d"), keywords).alias("a"), signals.explicit_expressions(F.col("t"), F.col("d"), keywords, F.col("k")).alias("b"))
    got = both.orderBy("i").collect()
    for r in got:
        assert r["a"] == r["b"], (texts[r["i"]], r)
    return [None if r["a"] is None else [(x["text"], x["signal"], x["signal_text"]) for x in r["a"]] for r in got]


def test_each_keyword_hits_or_never_can(spark):
    never = signals.unreachable(signals.KEYWORDS)
    assert never == {"point in time is", "time point is", "start time is", "end time is", "conclusion time is", "finished on"}
    rows = [(s, k) for s, ks in signals.KEYWORDS.items() for k in ks]
    texts = [f"it lay 1990 {k} 1999" if s == "DURATION" else f"it lay the {k} 1999" if k == "ending in" else f"it lay {k} 1999" for s, k in rows]
    for (s, k), found in zip(rows, _said(spark, texts)):
        told = {x[1] for x in found}
        shorter = [o for o, ks in signals.KEYWORDS.items() for x in ks if k == x or k.endswith(" " + x)]
        assert told <= set(shorter) | {"No signal"}, (k, found)
        assert s in told or k in never or any(k.endswith(" " + x) for ks in signals.KEYWORDS.values() for x in ks), (k, found)


def test_inflected_keywords(spark):
    texts = ["It was preceded by 1999", "Followed  by 1999", "he begins 1999", "the beginning 1999", "It ends 1999", "in the years 1999", "an ending in 1999", "ending in 1999", "1990 and 1999", "before, 1999", "", None, "nothing"]
    got = _said(spark, texts)
    assert got == [
        [("by 1999", "FINISH", "by")], [("by 1999", "FINISH", "by")], [("begins 1999", "START", "begins")], [("1999", "No signal", None)], [("ends 1999", "FINISH", "ends")],
        [("in the years 1999", "OVERLAP", "in the years")], [("in 1999", "OVERLAP", "in")], [("in 1999", "OVERLAP", "in")], [("1990 and 1999", "DURATION", None)], [("1999", "No signal", None)], [], None, [],
    ]


def test_tokens_and_forms_agree_on_random_texts(spark):
    rng = random.Random(5)
    words = sorted(KNOWN) + ["beginning", "began", "ends", "started", "preceding", "its", "a", "years", "dates", "times", ",", "(", "-", "Ann", "Opened", "the"]
    texts = ["".join(rng.choice([*words, "1999", "5 May 2001"]) + rng.choice([" ", " ", " ", "  ", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    _said(spark, texts)


def test_keywords_of_a_file(spark, tmp_path):
    (tmp_path / "k.txt").write_text("marry on||WED\non||OVERLAP\n\nno marks\ndivorce||PART\nsoon divorce||PART\nto||DURATION")
    keywords = signals.read_keywords(spark, str(tmp_path / "k.txt"))
    assert keywords == {"WED": ["marry on"], "OVERLAP": ["on"], "PART": ["divorce", "soon divorce"], "DURATION": ["to"]}
    got = _said(spark, ["soon divorcing 1999", "he married on 1999", "1990 to 1991", "since 1999"], keywords)
    assert got == [[("divorcing 1999", "PART", "divorcing")], [("on 1999", "OVERLAP", "on")], [("1990 to 1991", "DURATION", None)], [("1999", "No signal", None)]]
    assert _said(spark, ["it is 1999"], {"DURATION": ["to"], "X": ["is"]}) == [[("1999", "No signal", None)]]

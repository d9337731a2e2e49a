"""Annotations, tokens, infobox links and evidence of infoboxes and year pages."""

from pyspark.sql import functions as F

from chronoweave.functions import tokens
from chronoweave.operators.annotate import annotations
from chronoweave.operators.ordinals import annotate_ordinals
from chronoweave.plans import generate
from chronoweave.sources import html

from . import golden as fixtures


def test_annotations_are_numbered_and_nested(spark):
    rows = spark.createDataFrame([(1, "The second film came before 5 March 2003."), (2, "She ruled from 1990 to 1995, then the oldest man."), (3, ""), (4, None), (5, "no time at all")], "id int, text string")
    got = {r["id"]: r["a"] for r in rows.select("id", annotations(F.col("text")).alias("a")).collect()}
    assert [(x["id"], x["type"], x["mention"], x["signal"], x["ordinal"], list(x["nest"])) for x in got[1]] == [(0, "date", "5 March 2003", "", None, []), (1, "ordinal", "second", "ORDINAL", 2, []), (2, "explicit", "before 5 March 2003", "BEFORE", None, [0])]
    assert [(x["id"], x["type"], list(x["nest"])) for x in got[2]] == [(0, "date", []), (1, "date", []), (2, "ordinal", []), (3, "explicit", [0, 1])]
    assert got[3] == [] and got[4] is None and got[5] == []
    for i, t in ((1, "The second film came before 5 March 2003."), (2, "She ruled from 1990 to 1995, then the oldest man.")):
        assert all(t[x["s"] : x["e"]] == x["mention"] for x in got[i])


def test_ordinals_leave_by_place(spark):
    """An ordinal in a date goes; the same word elsewhere stays."""
    rows = spark.createDataFrame([("é the 21st man and the 21st woman",)], "t string")
    dates = F.array(F.struct(F.lit("the 21st man").alias("text"), F.lit(2).alias("s"), F.lit(14).alias("e")))
    assert [(x["ordinal"], x["s"], x["e"]) for x in rows.select(annotate_ordinals(F.col("t"), dates)).first()[0]] == [(21, 23, 27)]
    assert [(x["s"], x["e"]) for x in rows.select(annotate_ordinals(F.col("t"))).first()[0]] == [(6, 10), (23, 27)]


def test_tokens_and_a_model(spark):
    texts = ["Ann Lee  met Bob, in\nRome", "", None, "it's 1999"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", tokens.tokenizer()(F.col("t")).alias("x")).collect()}
    assert [(x["text"], x["spaced"], x["s"], x["e"], x["pos"]) for x in got[0]][:3] == [("Ann", "Ann ", 0, 3, "X"), ("Lee", "Lee  ", 4, 7, "X"), ("met", "met ", 9, 12, "X")]
    assert got[1] == [] and got[2] is None and [(x["text"], x["pos"]) for x in got[3]] == [("it's", "X"), ("1999", "NUM")]

    def names(batch):
        """Capitalised words are persons."""
        return [[(s, e, p, t, w, "PERSON" if w[:1] != text[s] else "") for s, e, p, t, w, _ in found] for text, found in zip(batch, tokens.rule_model(batch))]

    t = tokens.tokenizer(names)(F.col("t"))
    held = rows.select("i", t.alias("t")).select("i", tokens.entity_groups(F.col("t")).alias("g"), tokens.untokenized(tokens.part(F.col("t"), 1, 3)).alias("p")).collect()
    assert {r["i"]: [tuple(g) for g in r["g"] or []] for r in held} == {0: [("Ann Lee", "PERSON"), ("Bob", "PERSON"), ("Rome", "PERSON")], 1: [], 2: [], 3: []}
    assert [r["p"] for r in held if r["i"] == 0] == ["Lee  met"]


def test_infobox_links_know_earlier_anchors(spark):
    """The page's anchors are known from the start, the table's from where they stand on, and these win; sections are left out."""
    page = '<table class="infobox"><tr><td>Bob 1990</td></tr><tr><td><a href="/wiki/Robert">Bob</a> in <a href="/wiki/Rome#Old">Rome</a></td></tr><tr><td>Bob 1991</td></tr><tr><td>Bob 1991</td></tr></table><p><a href="/wiki/Bob_(man)">Bob</a></p>'
    got = html.infobox_evidence(spark.createDataFrame([(1, page)], "id int, html string"), "id").orderBy("row").collect()
    assert [(r["row"], r["evidence_text"], [tuple(x) for x in r["links"]]) for r in got] == [(0, "Bob 1990", [("Bob", "Robert")]), (1, "Bob in Rome", [("Bob", "Robert")]), (2, "Bob 1991", [("Bob", "Robert")])]


def test_evidence_of_infoboxes(spark):
    w = fixtures._wiki(spark)
    box = '<table class="infobox"><tr><th>Life</th></tr><tr><td>Spouse</td><td><a href="/wiki/Bob">Bob</a> (1990 and 1995)</td></tr><tr><td>Born</td><td>before 1960</td></tr><tr><td>1 2</td></tr><tr><td>1901, 1902, 1903</td></tr></table>'
    pages = spark.createDataFrame([("Q1", "Ann", box), ("Q9", "None", None)], "topic_id string, title string, html string")
    got = generate.info_evidence(pages, w["paths"], w["redirects"], w["labels"], w["entities"]).orderBy("index").collect()
    assert [(r["evidence_id"], r["source"], r["begin"], r["end"], [e["id"] for e in r["entities"]]) for r in got] == [("Q1:info:1", "info", 19900101, 19951231, ["Q3", "Q1"]), ("Q1:info:2", "info", 19600101, 19601231, ["Q1"])]
    assert got[0]["candidate_question_text"].startswith("Ann, Life, Spouse, Bob")
    assert list(got[0].asDict()) == spark.createDataFrame([], generate.EVIDENCE).columns


def test_evidence_of_year_pages(spark):
    """A year page's sentence needs one linked entity, the page is none, and the template loses the dates, if they are one or two."""
    w = fixtures._wiki(spark)
    prose = "In 2001 Bob won Gold Prize. Nobody saw Bob before 2001. In 2001 nothing. Bob had 2001 and 2001-00-00 in mind. Bob had 2001 and 2001-00-00 and 2001/0/0."
    pages = spark.createDataFrame([("Y1", "year", "MMI", prose)], "topic_id string, page_type string, title string, extract string")
    anchors = spark.createDataFrame([("Y1", 0, "Bob", "Bob"), ("Y1", 1, "Gold Prize", "Gold_Prize")], "topic_id string, pos int, text string, path string")
    got = generate.text_evidence(pages, anchors, w["paths"], w["redirects"], w["labels"], w["entities"]).orderBy("index").collect()
    assert [(r["evidence_id"], r["page_type"], [e["id"] for e in r["entities"]], r["begin"], r["end"]) for r in got] == [(f"Y1:text:{i}", "year", ids, 20010101, 20011231) for i, ids in ((0, ["Q3", "Q4"]), (3, ["Q3"]), (4, ["Q3"]))]
    assert [r["candidate_question_text"].count("2001") for r in got] == [0, 0, 3]


def test_evidence_of_chosen_sources(spark):
    w = fixtures._wiki(spark)
    box = '<table class="infobox"><tr><td>Spouse</td><td><a href="/wiki/Bob">Bob</a> (2001)</td></tr></table>'
    w["pages"] = w["pages"].withColumn("html", F.when(F.col("topic_id") == "Q1", box))
    found = {s: generate.all_evidence(**w, sources=s) for s in ((), ("kb",), ("info", "text"))}
    assert {s: sorted(r["source"] for r in df.collect()) for s, df in found.items()} == {(): [], ("kb",): ["kb", "kb"], ("info", "text"): ["info", "text", "text"]}
    assert all(df.columns == spark.createDataFrame([], generate.EVIDENCE).columns for df in found.values())
    questions = generate.pseudo_questions(generate.all_evidence(**w), need_similar=False).collect()
    assert any("info" in r["source"] for r in questions)

"""Cases over small hand-made inputs, with the rows that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import dates, predicates, relations
from chronoweave.operators import kb, link, ordinals, questions, rephrase, signals
from chronoweave.sources import html
from chronoweave.plans import generate

CASES: dict[str, tuple] = {}


def fixture(columns: str, expected: list[tuple]):
    """Register a case: a function whose rows, in ``columns``, are ``expected``."""

    def add(f):
        CASES[f.__name__] = f, columns.split(", "), expected
        return f

    return add


_RELATIONS = [
    (1, 20020101, 20021231, 20020101, 20021231, "OVERLAP"), (2, 20020310, 20020310, 20020308, 20020308, "AFTER"), (3, 20020312, 20020312, 20020308, 20020308, None),
    (4, 20020308, 20020308, 20020310, 20020310, "BEFORE"), (5, 20020308, 20020308, 20020308, 20020320, "OVERLAP"), (6, 20020301, 20020308, 20020308, 20020320, "BEFORE"),
    (7, 20020308, 20020320, 20020301, 20020308, "AFTER"), (8, 20020305, 20020315, 20020301, 20020320, "OVERLAP"), (9, 20020301, 20020310, 20020305, 20020320, "OVERLAP"),
    (10, 20020101, 20021231, 20010101, 20011231, None), (11, 20010101, 20011231, 20020101, 20021231, None), (12, 20020101, 20021231, 20000101, 20021231, "AFTER"),
    (13, 20000101, 20021231, 20020101, 20021231, "BEFORE"), (14, 20000101, 20051231, 20020101, 20021231, "OVERLAP"), (15, 20020101, 20041231, 20030101, 20061231, "OVERLAP"),
    (16, 20030101, 20030101, 20020101, 20021231, None), (17, 20021231, 20021231, 20030101, 20030101, None), (18, 20020131, 20020131, 20020201, 20020201, None), (19, 20020520, 20020520, 20020101, 20021231, "OVERLAP"),
]


@fixture("id, signal", [(r[0], r[5]) for r in _RELATIONS])
def relation_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:5] for r in _RELATIONS], "id int, b int, e int, cs int, ce int")
    return rows.select("id", relations.signal(F.col("b"), F.col("e"), F.col("cs"), F.col("ce")).alias("signal"))


_DATES = [
    ("1987, April 11–June 9", "1987-04-11/1987-06-09"), ("1987–1991", "1987-01-01/1991-12-31"), ("1987, April 11–17", "1987-04-11/1987-04-17"), ("6 June 1912 – 1931", "1912-06-06/1931-12-31"),
    ("3 August 1944 – 21 October 1944", "1944-08-03/1944-10-21"), ("August 3, 1944 – October 21, 1944", "1944-08-03/1944-10-21"), ("1987, April 11", "1987-04-11/1987-04-11"), ("8 April 1987", "1987-04-08/1987-04-08"),
    ("April 8, 1987", "1987-04-08/1987-04-08"), ("April 1936", "1936-04-01/1936-04-31"), ("February 1936", "1936-02-01/1936-02-31"), ("1954", "1954-01-01/1954-12-31"), ("1954,", "1954-01-01/1954-12-31"), ("(1954),", ""),
    ("1987-06-19", "1987-06-19/1987-06-19"), ("1987/6/9", "1987-06-09/1987-06-09"), ("1987.06.19", "1987-06-19/1987-06-19"), ("1987-06-00", "1987-06-01/1987-06-31"), ("1987-00-00", "1987-01-01/1987-12-31"),
    ("1987-13-01", ""), ("11/26/1987", "1987-11-26/1987-11-26"), ("26/11/1987", "1987-11-26/1987-11-26"), ("26/11/1987,", "1987-11-26/1987-11-26"), ("1987-06", ""), ("123 May 1987", "1987-05-123/1987-05-123"), ("007 May 1987", "1987-05-007/1987-05-007"),
]


@fixture("text, span", _DATES)
def date_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in _DATES], "text string")
    shown = F.transform(dates.annotate_dates(F.col("text")), lambda x: F.concat_ws("/", dates.timestamp_date(x["begin"]), dates.timestamp_date(x["end"])))
    return rows.select("text", F.array_join(shown, ";").alias("span"))


_OVERLAPS = [(1, [(0, 10), (0, 4)], "0-10"), (2, [(0, 4), (0, 10)], "0-10"), (3, [(0, 4), (4, 8)], "4-8"), (4, [(0, 3), (2, 8), (7, 20)], "7-20"), (5, [(0, 4), (6, 9)], "0-4,6-9")]


@fixture("id, kept", [(i, k) for i, _, k in _OVERLAPS])
def overlap_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, [("x", "m", "b", "e", s, e) for s, e in spans]) for i, spans, _ in _OVERLAPS], f"id int, d array<{dates.DATE}>")
    return rows.select("id", F.array_join(F.transform(dates.resolve_overlaps(F.col("d")), lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("kept"))


def _fact(*items: str) -> list[tuple[str, str]]:
    return [(i.split("=")[0], i.split("=")[1]) for i in items]


_1990, _1995, _1980 = ("1990-01-01T00:00:00Z=1990", "1995-01-01T00:00:00Z=1995", "1980-01-01T00:00:00Z=1980")
_FACTS = [
    ("Q1", 1, _fact("Q1=Ann", "P26=spouse", "Q2=Bob", "P580=start time", _1990, "P582=end time", _1995)), ("Q1", 2, _fact("Q1=Ann", "P26=spouse", "Q2=Bob", "P580=start time", _1990)),
    ("Q1", 3, _fact("Q1=Ann", "P166=award", "Q3=Prize", "P585=point in time", "2001-05-04T00:00:00Z=4 May 2001")), ("Q1", 4, _fact("Q1=Ann", "P1=x", "Q4=Y", "P582=end time", "2001-05-04T00:00:00Z=4 May 2001")),
    ("Q1", 5, _fact("Q1=Ann", "P571=inception", _1980)), ("Q1", 6, _fact("Q1=Ann", "P31=is", "Q5=human")),
    ("Q7", 1, _fact("Q7=Org", "P580=start time", _1990)), ("Q7", 2, _fact("Q7=Org", "P582=end time", _1995)),
]


@fixture("topic_id, rule, template, span, answers", [
    ("Q1", "start_end", "Ann spouse Bob", "19900101-19951231", "Q2"), ("Q1", "start_end", "Ann spouse Bob", "19900101-20501231", "Q2"), ("Q1", "point", "Ann award Prize", "20010504-20010504", "Q3"), ("Q1", "last", "Ann x Y", "20010504-20010504", "Q4"),
    ("Q1", "triple_inception", "Ann inception", "19800101-20501231", ""), ("Q7", "triple_start_end", "Org start time", "19900101-19951231", ""), ("Q7", "triple_point", "Org start time", "19900101-19901231", ""), ("Q7", "triple_point", "Org end time", "19950101-19951231", ""),
])
def kb_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kb.kb_evidence(spark.createDataFrame(_FACTS, f"topic_id string, fact_no int, fact {kb.FACT}"))
    return found.select("topic_id", "rule", F.col("candidate_question_text").alias("template"), F.concat_ws("-", F.col("start_time_int").cast("string"), F.col("end_time_int").cast("string")).alias("span"), F.array_join("answer_ids", ",").alias("answers"))


_BOX = '<div class="navbox"><a href="/wiki/Nav">Navigation</a></div><table class="infobox"><tr><th>Career</th></tr><tr><th>Spouse</th><td><a href="/wiki/Bob">Bob</a><br>(m. 1990)</td></tr><tr><th>Born</th><td>1 May 1960</td></tr></table><p><a href="/wiki/Bob">Bob</a> <a href="/wiki/File:X.png">File here</a> <a href="/wiki/New_York">New York</a> <a href="/wiki/York">York</a></p>'


@fixture("id, evidence_text", [(1, "Career, Spouse, Bob, (m. 1990)"), (1, "Career, Born, 1 May 1960")])
def infobox_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.infobox_evidence(spark.createDataFrame([(1, _BOX), (2, None)], "id int, html string"), "id").select("id", "evidence_text")


@fixture("id, text, href", [(1, "Bob", "/wiki/Bob"), (1, "New York", "/wiki/New_York"), (1, "York", "/wiki/York")])
def wiki_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_anchors(spark.createDataFrame([(1, _BOX), (2, None)], "id int, html string"), "id").select("id", "text", "href")


@fixture("id, links", [(1, "Bob@0-3,New York@14-22")])
def anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Bob moved to  New York.", [("Bob", "Bob"), ("York", "York"), ("New York", "New_York"), ("moved", "#x")])], "id int, text string, anchors array<struct<text:string,path:string>>")
    shown = F.transform(F.array_sort(link.link_anchors(F.col("text"), F.col("anchors")), lambda a, b: a["s"] - b["s"]), lambda x: F.concat(x["text"], F.lit("@"), x["s"].cast("string"), F.lit("-"), x["e"].cast("string")))
    return rows.select("id", F.array_join(shown, ",").alias("links"))


_ORDINALS = [("the first man", "first=1"), ("the 21st century", "21st=21"), ("the oldest man", "oldest=0"), ("the latest news", "latest=-1"), ("fourteen men here", "fourteen=14"), ("the fourteenth man", ""), ("the first largest city", ""), ("on the 2nd March there", ""), ("the forty-first man", "forty-first=41"), ("the most recent man", "most recent=-1"), ("it was most recent", "")]


@fixture("text, found", _ORDINALS)
def ordinal_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in _ORDINALS], "text string")
    return rows.select("text", F.array_join(F.transform(ordinals.annotate_ordinals(F.col("text")), lambda x: F.concat(x["text"], F.lit("="), x["ordinal"].cast("string"))), ",").alias("found"))


_SIGNALS = [("Ann met Bob before 1999.", "before 1999=BEFORE"), ("Ann ruled from 1990 to 1995.", "1990 to 1995=DURATION"), ("Ann sang in the year 1999", "in the year 1999=OVERLAP"), ("Ann 1999", "1999=No signal"), ("Followed by 2001 was it", "by 2001=FINISH"), ("since 5 March 2003 it rained", "since 5 March 2003=START"), ("until 2004", "until 2004=FINISH")]


@fixture("text, found", _SIGNALS)
def signal_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in _SIGNALS], "text string")
    return rows.select("text", F.array_join(F.transform(signals.explicit_expressions(F.col("text")), lambda x: F.concat(x["text"], F.lit("="), x["signal"])), ",").alias("found"))


@fixture("signal, n", [(s, len(k)) for s, k in signals.KEYWORDS.items()])
def signal_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.keyword_table(spark).select("signal", F.size("keywords").alias("n"))


_FACT_PAIRS = [(1, "Ann died in Rome", "Ann, date of death, 1999", 19990101, 20000101, "Q1", True), (2, "Ann was born", "birthdate of Ann", 19990101, 20000101, "Q1", True), (3, "Ann spouse Bob", "Bob spouse Ann", 19990101, 19990101, "Q2", True), (4, "Ann sang", "Bob sang", 19990101, 19990101, "Q1", True), (5, "Ann sang", "Bob sang", 19990101, 20010101, "Q1", False), (6, "Ann sang", "Bob sang", 19990101, 19990101, "Q2", False)]


@fixture("id, same", [(r[0], r[6]) for r in _FACT_PAIRS])
def same_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = spark.createDataFrame([r[:6] for r in _FACT_PAIRS], "id int, a string, z string, b int, cs int, q string")
    return rows.select("id", predicates.same_fact(c("a"), c("z"), c("b"), c("b"), c("cs"), c("cs"), F.array(F.lit("Q1")), F.array(c("q"))).alias("same"))


_SNIPPETS = [(1, "text", [1], ["OVERLAP"], True), (2, "text", [1, 2], [], False), (3, "text", [1, 1], ["BEFORE"], False), (4, "info", [1, 2], ["BEFORE"], True), (5, "info", [1, 2, 3], [], False), (6, "kb", [1], [], False)]


@fixture("id, kept", [(r[0], r[4]) for r in _SNIPPETS])
def snippet_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in _SNIPPETS], "id int, source string, spans array<int>, signals array<string>")
    return rows.select("id", predicates.snippet_kept(F.col("source"), F.col("spans"), F.col("signals")).alias("kept"))


@fixture("evidence_id, answer_id, question_ids, main_pseudo_question", [("0-1", "Q2", "Q3,Q1", "What film was released by Ann"), ("0-2", "Q4", "Q1", "What award Ann award")])
def main_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = "array<struct<id:string,label:string,type:string,disam_label:string>>"
    rows = [("0-1", "text", "The Film was released by Ann", [("Q2", "Film", "film", "The Film")], [("Q2",), ("Q3",), ("Q1",)]), ("0-2", "kb", "Ann award Prize", [("Q4", "Prize", "award", None)], [("Q1",), ("Q4",)]), ("0-3", "kb", "nothing", [], [("Q1",)])]
    df = spark.createDataFrame(rows, f"evidence_id string, source string, candidate_question_text string, answers {e}, entities array<struct<id:string>>")
    return questions.main_parts(df).select("evidence_id", "answer_id", F.array_join("question_ids", ",").alias("question_ids"), "main_pseudo_question")


@fixture("prompt_cached, rephrase_question, flaw", [(True, "Who sang the song that Ann wrote after the tour?", None), (False, "What album came out by Ann after Ann won the prize?", None)])
def rephrase_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([("Who sang, after, the tour", "AFTER"), ("What album came out by Ann, after, Ann won the prize.", "AFTER")], "question string, signal string")
    cache = q.limit(1).select(rephrase.prompt(F.col("question")).alias("prompt"), F.lit("Who sang the song that Ann wrote after the tour?").alias("question"), F.lit(1.0).alias("version"))
    out = rephrase.checked(rephrase.rephrased(q, cache), F.lit(1), F.lit(2), F.col("signal"))
    return out.select((F.col("question") == "Who sang, after, the tour").alias("prompt_cached"), "rephrase_question", "flaw")


@fixture("mains, constraint_evidence, entities, answers", [("kb/m1,kb/m1,text/m2", "c", "Q1,Q2", "Q9,Q8")])
def final_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "struct<id:string,label:string>"
    rows = [("r", "p", "AFTER", ["m1", "m1", "m2", "c"], ["kb", "info", "text", "kb"], [[1, 2]] * 4, ("Q0", "t"), [[("Q1", "a"), ("Q2", "b")], [("Q1", "z")]], [("Q9", "x"), ("Q9", "y"), ("Q8", "w")])]
    df = spark.createDataFrame(rows, f"rephrase_question string, pseudo_question_construction string, signal string, evidence array<string>, source array<string>, timespan array<array<int>>, topic_entity {s}, question_entity array<array<{s}>>, answer array<{s}>")
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    out = questions.final_questions(df)
    return out.select(F.array_join(F.transform("evidence.main", lambda x: F.concat_ws("/", x["source"], x["evidence"])), ",").alias("mains"), F.col("evidence.constraint.evidence").alias("constraint_evidence"), ids("question_entity").alias("entities"), ids("answer").alias("answers"))


@fixture("year, id, wiki_path, page_type", [(2001, "Q1", "2001", "year"), (2002, "Q2", "2002", "year"), (2001, "Q5", "Portal:Current_events/May_2001", "event"), (2002, "Q6", "June_2002", "event")])
def page_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoweave.operators.generators import page_pool as pool

    years = spark.createDataFrame([(2001,), (2002,), (2003,)], "year int")
    paths = spark.createDataFrame([("2001", "Q1"), ("20.02", "Q2"), ("Portal:Current_events/May_2001", "Q5"), ("May_2001", "Q7"), ("June_2002", "Q6"), ("July_2002", "Q2")], "path string, id string")
    return pool(years, paths)


def _wiki(spark: SparkSession) -> dict[str, DataFrame]:
    """Two pages, their anchors, and facts about the singer Ann."""
    entity = "Q1 Ann human,Q2 Blue_Album album,Q3 Bob human,Q4 Gold_Prize award"
    rows = [r.split() for r in entity.split(",")]
    prose = "Ann was a singer. Ann released Blue Album with Bob in 2001. In 1990 and 1995 Ann slept. == Further reading == Ann in 1999."
    facts = [("Q1", 1, _fact("Q1=Ann", "P166=award received", "Q4=Gold Prize", "P585=point in time", "2001-01-01T00:00:00Z=2001")), ("Q1", 2, _fact("Q1=Ann", "P26=spouse", "Q3=Bob", "P580=start time", "2000-01-01T00:00:00Z=2000", "P582=end time", "2004-01-01T00:00:00Z=2004"))]
    return {
        "pages": spark.createDataFrame([("Q1", "entity", "Ann", prose), ("Q9", "entity", "None", None)], "topic_id string, page_type string, title string, extract string"),
        "anchors": spark.createDataFrame([("Q1", 0, "Blue Album", "Blue_Album"), ("Q1", 1, "Bob", "Robert"), ("Q1", 2, "Album", "Album")], "topic_id string, pos int, text string, path string"),
        "paths": spark.createDataFrame([(r[1], r[0]) for r in rows], "path string, id string"),
        "redirects": spark.createDataFrame([("Robert", "Bob")], "from_path string, to_title string"),
        "labels": spark.createDataFrame([(r[0], [r[1].replace("_", " ")]) for r in rows], "id string, labels array<string>"),
        "entities": spark.createDataFrame([(r[0], r[2], [5]) for r in rows], "id string, type string, frequency array<bigint>"),
        "facts": spark.createDataFrame(facts, f"topic_id string, fact_no int, fact {kb.FACT}"),
    }


def _evidence(spark: SparkSession) -> DataFrame:
    w = _wiki(spark)
    told = generate.text_evidence(w["pages"], w["anchors"], w["paths"], w["redirects"], w["labels"], w["entities"])
    return told.unionByName(generate.fact_evidence(w["facts"], w["labels"], w["entities"]))


@fixture("evidence_id, template, begin_day, end_day, entities", [
    ("Q1:text:1", "Ann, Ann released Blue Album with Bob.", 20010101, 20011231, "Q2/album,Q3/human,Q1/human"), ("Q1:text:2", "Ann, In Ann slept.", 19900101, 19951231, "Q1/human"),
    ("Q1:kb:1:point", "Ann award received Gold Prize", 20010101, 20011231, "Q1/human,Q4/award"), ("Q1:kb:2:start_end", "Ann spouse Bob", 20000101, 20041231, "Q1/human,Q3/human"),
])
def generated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("entities", lambda x: F.concat_ws("/", x["id"], x["type"])), ",")
    return _evidence(spark).select("evidence_id", F.col("candidate_question_text").alias("template"), F.col("begin").alias("begin_day"), F.col("end").alias("end_day"), shown.alias("entities"))


@fixture("main_id, constraint_id, signal, source, question", [
    ("Q1:text:1", "Q1:kb:2:start_end", "OVERLAP", "text; kb", "What album Ann, Ann released with Bob., during, Ann spouse Bob"), ("Q1:text:1", "Q1:kb:1:point", "OVERLAP", "text; kb", "What album Ann, Ann released with Bob., during, Ann award received Gold Prize"),
    ("Q1:kb:1:point", "Q1:text:1", "OVERLAP", "kb; text", "What award Ann award received, during, Ann, Ann released Blue Album with Bob."), ("Q1:kb:1:point", "Q1:kb:2:start_end", "OVERLAP", "kb; kb", "What award Ann award received, during, Ann spouse Bob"),
    ("Q1:kb:2:start_end", "Q1:kb:1:point", "OVERLAP", "kb; kb", "What human Ann spouse, during, Ann award received Gold Prize"),
])
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.pseudo_questions(_evidence(spark), need_similar=False).select("main_id", "constraint_id", "signal", "source", "question")


@fixture("topic_id, source, rephrase_question, answer", [("Q1", "kb; text", "What award Ann award received during Ann, Ann released Blue Album with Bob?", "Q4")])
def finished_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = generate.finished_questions(generate.pseudo_questions(_evidence(spark), need_similar=False))
    return out.select("topic_id", "source", "rephrase_question", F.array_join(F.transform("answers", lambda x: x["id"]), ",").alias("answer"))

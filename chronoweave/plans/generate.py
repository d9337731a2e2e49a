"""The whole way: evidence of pages and facts, pseudo-questions, finished questions.

Each phase is written to the shared folder, so that later ones, which read it several times, neither repeat
its work nor carry its plan.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import annotate_dates, merged_span, remove_spans, timestamp_int
from ..functions.predicates import answerable, constraint_sentence, meaningless_relation, no_relation, non_date_entities, snippet_kept, year_snippet_kept
from ..functions.text import clean_template, clean_year_template, page_prose, sentences
from ..operators import questions as q
from ..operators.kb import facts_of, kb_evidence
from ..operators.link import linked_texts, resolve_paths, titled, with_labels, with_types
from ..operators.records import SOURCES, union_all, with_similar_main
from ..operators.rephrase import checked, rephrased
from ..operators.sample import inverse_weights, weighted_pick
from ..operators.signals import explicit_expressions
from ..providers import hashed_embedding
from ..session import Totals, stored
from ..sources.html import infobox_evidence
from ..sources.service import Service

EVIDENCE = "evidence_id string, topic_id string, source string, page_type string, index int, evidence_text string, candidate_question_text string, begin int, end int, entities array<struct<id:string,label:string,type:string,disam_label:string>>, main_fact boolean"
#: Days outside are no evidence, as yyyymmdd.
FIRST_DAY, LAST_DAY = 10000101, 20501231


def _step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once: the generator keeps Spark from repeating it wherever it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_entities(rows: DataFrame, mentions: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """``rows`` with their ``mentions(evidence_id, id, place, mention)`` as typed and labelled entities, in the order of places, each once."""
    # Dealt and sorted by evidence once, for the window and the join.
    typed = with_labels(with_types(mentions, entities), labels)
    own = Window.partitionBy("evidence_id").orderBy("place", "id")
    named = F.collect_list(F.struct("id", "label", "type", F.col("mention").alias("disam_label"))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = typed.select("evidence_id", named.alias("e"), F.row_number().over(own).alias("_r")).where("_r = 1")
    # Of several mentions the place is the first one's, the name the last one's.
    last = lambda x: F.element_at(F.filter("e", lambda y: y["id"].eqNullSafe(x["id"])), -1)["disam_label"]
    first = F.filter("e", lambda x, i: ~F.exists(F.slice("e", F.lit(1), i), lambda y: y["id"].eqNullSafe(x["id"])))
    once = F.transform(first, lambda x: F.struct(x["id"], x["label"], x["type"], last(x).alias("disam_label")))
    distinct = F.size(F.array_distinct(F.col("e")["id"])) == F.size("e")
    return rows.join(held.select("evidence_id", F.when(distinct, F.col("e")).otherwise(once).alias("entities")), "evidence_id")


def text_evidence(pages: DataFrame, anchors: DataFrame, paths: DataFrame, redirects: DataFrame, labels: DataFrame, entities: DataFrame, most_entities: int = 3, abbreviations: Collection[str] = (), keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Evidence of the sentences of ``pages(topic_id, page_type, title, extract)`` that tell one time.

    ``anchors``: (topic_id, pos, text, path) of each page; ``abbreviations``: those that ``operators.abbreviations`` learns; ``keywords``: of a
    file that ``operators.signals`` reads, the library's own without. Sentences without a date go before anything is
    linked; a page's anchors meet only its own sentences, in one automaton.
    """
    told = pages.select("topic_id", "page_type", "title", F.posexplode(sentences(page_prose(F.col("extract")), abbreviations)).alias("index", "sentence"))
    told = _step(told, "evidence_text", titled(F.col("title"), F.col("sentence")))
    told = _step(told, "dates", annotate_dates(F.col("evidence_text"))).where(F.size("dates") > 0)
    told = _step(told, "told", explicit_expressions(F.col("evidence_text"), F.col("dates"), keywords))
    spans, signals = F.transform("told", lambda x: F.struct(x["begin"], x["end"])), F.transform("told", lambda x: x["signal"])
    told = told.where(F.when(F.col("page_type") == "year", year_snippet_kept(spans, signals)).otherwise(snippet_kept(F.lit("text"), spans, signals)))
    told = stored(told.withColumn("evidence_id", F.format_string("%s:text:%d", "topic_id", "index")), "told")
    # A page without anchors still tells of itself.
    links = linked_texts(told, anchors, "topic_id", "evidence_id", "sentence").drop("topic_id")
    rows = told.join(links, "evidence_id")
    rows = stored(rows, "snippets")
    return _linked_evidence(rows, "text", paths, redirects, labels, entities, most_entities)


def info_evidence(pages: DataFrame, paths: DataFrame, redirects: DataFrame, labels: DataFrame, entities: DataFrame, most_entities: int = 3) -> DataFrame:
    """Evidence of the infobox rows of entity ``pages(topic_id, title, html)`` that tell one time or two; rows without a date go before anything is linked."""
    cells = infobox_evidence(pages, "topic_id").join(pages.select("topic_id", "title"), "topic_id")
    told = cells.select("topic_id", F.lit("entity").alias("page_type"), "title", F.col("row").alias("index"), titled(F.col("title"), F.col("evidence_text")).alias("evidence_text"), F.col("links").alias("known"))
    told = _step(told, "dates", annotate_dates(F.col("evidence_text"))).where(F.size("dates") > 0)
    told = _step(told, "told", explicit_expressions(F.col("evidence_text"), F.col("dates")))
    spans, signals = F.transform("told", lambda x: F.struct(x["begin"], x["end"])), F.transform("told", lambda x: x["signal"])
    rows = told.where(snippet_kept(F.lit("info"), spans, signals)).withColumn("evidence_id", F.format_string("%s:info:%d", "topic_id", "index"))
    placed = F.transform("known", lambda x: F.struct(x["text"].alias("text"), x["path"].alias("path"), (F.position(x["text"], F.col("evidence_text")) - 1).alias("s")))
    return _linked_evidence(stored(rows.withColumn("links", placed), "cells"), "info", paths, redirects, labels, entities, most_entities)


def _linked_evidence(rows: DataFrame, source: str, paths: DataFrame, redirects: DataFrame, labels: DataFrame, entities: DataFrame, most_entities: int) -> DataFrame:
    """Told rows with ``links`` to evidence: linked pages and the page itself as entities, in the span that all told ones are merged to."""
    links = rows.select("evidence_id", F.explode("links").alias("l")).select("evidence_id", F.col("l.path").alias("path"), F.col("l.s").alias("place"), F.col("l.text").alias("mention"))
    linked = resolve_paths(links, paths, redirects).where("id is not null").select("evidence_id", "id", "place", "mention")
    page = rows.select("evidence_id", F.col("topic_id").alias("id"), F.lit(1 << 30).alias("place"), F.col("title").alias("mention"))
    mentioned = linked.unionByName(page.join(rows.where("page_type = 'entity'").select("evidence_id"), "evidence_id", "left_semi"))
    out = _with_entities(rows, mentioned, labels, entities)
    n = F.size(non_date_entities(F.col("entities")))
    out = out.where(F.when(F.col("page_type") == "year", n >= 1).otherwise(n.between(1, most_entities)))
    said, year_said = (F.transform("told", lambda x: F.struct(x["s"], x["e"])), F.transform("dates", lambda x: F.struct(x["s"], x["e"])))
    year_said = F.when(F.size("dates") <= 2, year_said).otherwise(F.filter(year_said, lambda x: F.lit(False)))
    template = F.when(F.col("page_type") == "year", clean_year_template(remove_spans(F.col("evidence_text"), year_said))).otherwise(clean_template(remove_spans(F.col("evidence_text"), said)))
    span = merged_span(F.transform("told", lambda x: x["begin"]), F.transform("told", lambda x: x["end"]))
    return out.select(
        "evidence_id", "topic_id", F.lit(source).alias("source"), "page_type", "index", "evidence_text", template.alias("candidate_question_text"),
        timestamp_int(span["begin"]).alias("begin"), timestamp_int(span["end"]).alias("end"), "entities", F.lit(True).alias("main_fact"),
    )


def fact_evidence(facts: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence of ``facts(topic_id, fact_no, fact)``, as ``kb.facts_of`` gives them, in the same columns; facts that only bound others are no mains."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    evidence_id = F.concat(said("topic_id"), F.lit(":kb:"), said("fact_no"), F.lit(":"), said("rule"))
    found = kb_evidence(facts, keep=lambda df: stored(df.withColumn("evidence_id", evidence_id), "facts", dictionary=False))
    mentions = found.select("evidence_id", F.posexplode("entity_ids").alias("place", "id")).withColumn("mention", F.lit(None).cast("string"))
    rows = _with_entities(found, mentions, labels, entities)
    main = F.coalesce("main_fact", F.lit(False)) & (F.size("answer_ids") > 0)
    return rows.select(
        "evidence_id", "topic_id", F.lit("kb").alias("source"), F.lit("entity").alias("page_type"), F.lit(0).alias("index"), "evidence_text", "candidate_question_text",
        F.col("start_time_int").alias("begin"), F.col("end_time_int").alias("end"), "entities", main.alias("main_fact"),
    )


def all_evidence(pages: DataFrame, anchors: DataFrame, facts: DataFrame | Service, paths: DataFrame, redirects: DataFrame | Service, labels: DataFrame | Service, entities: DataFrame | Service, sources: tuple[str, ...] = SOURCES, most_facts: int = 1000) -> DataFrame:
    """Evidence of the ``sources`` that are asked for, in the columns EVIDENCE; others are not worked out.

    ``pages(topic_id, page_type, title, extract, html)``; infoboxes are read of entity pages alone, and of ``facts(fact_id, fact)`` the
    first ``most_facts`` that name an entity page. Facts that have a topic_id and fact_no already are taken as they are. Redirects, labels,
    entities and facts are tables or services.
    """
    if unknown := set(sources) - set(SOURCES):
        raise ValueError(f"no such source: {sorted(unknown)}")

    def known_facts() -> DataFrame:
        if isinstance(facts, DataFrame) and "topic_id" in facts.columns:
            return facts
        return facts_of(pages.where("page_type = 'entity'"), facts, most_facts)

    parts = {
        "kb": lambda: fact_evidence(known_facts(), labels, entities),
        "text": lambda: text_evidence(pages.drop("html"), anchors, paths, redirects, labels, entities),
        "info": lambda: info_evidence(pages.where("page_type = 'entity'"), paths, redirects, labels, entities),
    }
    chosen = [parts[s]() for s in SOURCES if s in sources]
    return union_all(*chosen) if chosen else labels.sparkSession.createDataFrame([], EVIDENCE)


def pseudo_questions(evidence: DataFrame, embed: Callable[[Column], Column] = hashed_embedding, max_words: int = q.MAX_WORDS, need_similar: bool = True, totals: Totals | None = None) -> DataFrame:
    """Mains and constraints of ``evidence`` (columns EVIDENCE) joined by entities and time, with similar questions merged into earlier ones.

    With ``need_similar`` only mains that another main of their topic is similar to are asked. ``totals`` gets the numbers of evidence and questions.
    Returns (topic_id, question_id, main_id, constraint_id, signal, question, source, sources, answers, answer, question_ids, spans, similar).
    """
    names = F.transform("entities", lambda x: F.coalesce(x["disam_label"], x["label"]))
    inside = F.col("begin").between(FIRST_DAY, LAST_DAY) & F.col("end").between(FIRST_DAY, LAST_DAY)
    meant = inside & ~meaningless_relation(F.col("evidence_text"), F.col("source")) & ~no_relation(F.col("candidate_question_text"), names)
    # Written with what the tests on texts say, so that mains, constraints and their counts do not test anew.
    told = stored(evidence.withColumn("meant", meant), "evidence", totals=totals, dictionary=False).where("meant")
    about = told.where((F.col("page_type") == "entity") & F.col("main_fact")).withColumn("answers", answerable(F.col("entities"), F.col("topic_id")))
    parts = q.main_parts(about, ("topic_id", "begin", "end", "answers"))
    mains = parts.select(F.col("evidence_id").alias("main_id"), F.col("main_pseudo_question").alias("text"), F.col("main_question_text").alias("told"), "begin", "end", "question_ids", F.array("answer_id").alias("answer_ids"), "topic_id", "source", F.get("answers", F.lit(0)).alias("answer"))
    if need_similar:
        near = _similar_mains(mains, embed)
        mains = with_similar_main(mains, near)
    bounds = told.where(constraint_sentence(F.col("index"), F.col("source"), F.col("page_type")))
    constraints = bounds.select(F.col("evidence_id").alias("constraint_id"), F.col("candidate_question_text").alias("text"), "begin", "end", F.col("entities")["id"].alias("entity_ids"), F.col("source").alias("constraint_source"))
    pairs = q.temporal_pairs(mains, constraints, max_words, main_columns=("topic_id", "source", "answer", "question_ids", "text"), constraint_columns=("constraint_source",))
    spans = F.array(F.array("b", "e"), F.array("cs", "ce"))
    asked = pairs.select("topic_id", F.concat_ws("|", "main_id", "constraint_id").alias("question_id"), "main_id", "constraint_id", "signal", "question", F.concat_ws("; ", "source", "constraint_source").alias("source"), F.array("source", "constraint_source").alias("sources"), F.array("answer").alias("answers"), "answer", "question_ids", spans.alias("spans"), "text")
    asked = stored(asked, "questions", totals=totals, dictionary=False)
    if not need_similar:
        # Only mains that share a constraint and signal with another main of their topic can be similar to any effect.
        shared = ["topic_id", "constraint_id", "signal"]
        several = asked.groupBy(*shared).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*shared)
        own = asked.join(several, shared, "left_semi").select("main_id", "topic_id", F.get("sources", F.lit(0)).alias("source"), "text", F.get("spans", F.lit(0))[0].alias("begin"), F.get("spans", F.lit(0))[1].alias("end"))
        near = _similar_mains(own.dropDuplicates(["main_id"]), embed)
    asked = asked.drop("text")
    named = asked.withColumnRenamed("topic_id", "topic")
    similar = q.similar_questions(named.select("topic", "question_id", "main_id", "constraint_id", "signal"), near.select("main_id", "other"))
    return q.merge_similar(asked, similar.select("question_id", "other_id"), ["main_id", "answer", "source", "answers", "sources", "spans", "question_ids"])


def _similar_mains(mains: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Pairs ``(main_id, other)`` of similar ``mains(main_id, topic_id, source, text, begin, end)`` of a topic."""
    # Written, so that the tests on vectors do not embed anew.
    vectors = stored(mains.select("main_id", "topic_id", "source", F.struct("begin", "end").alias("span"), embed(F.col("text")).alias("vector")), "vectors")
    return q.similar_pairs(vectors, "main_id", "topic_id", "vector", q.similar_threshold(F.col("source"), F.col("other_source")), "span", least=0.7)


def finished_questions(pseudo: DataFrame, cache: DataFrame | None = None, provider=None, seed: int = 0, totals: Totals | None = None) -> DataFrame:
    """One question per topic, drawn so that rare combinations of sources count more, rephrased; flawed ones go.

    Sources, spans, entities and main ids are the question's and those of the similar ones that it took in.
    Returns (topic_id, question_id, signal, source, question, rephrase_question, answers, n_words, check_signal, main_ids, sources, spans, question_ids).
    """
    pseudo = stored(pseudo, "pseudo-questions", totals=totals)
    picked = weighted_pick(pseudo, inverse_weights(pseudo, "source"), "topic_id", "source", "question_id", seed)
    merged = q.with_slots_of_similar(picked, ("sources", "spans"), entities="question_ids").withColumn("answers", q.first_by(F.col("answers"), "id"))
    out = checked(rephrased(merged, cache, provider), F.size("answers"), F.size("question_ids"), F.col("signal"))
    return out.where("flaw is null").select("topic_id", "question_id", "signal", "source", "question", "rephrase_question", "answers", "n_words", "check_signal", "main_ids", "sources", "spans", "question_ids")

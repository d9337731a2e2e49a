"""Knowledge-base facts to timed evidence.

A fact is ``array<struct<id, label>>``: subject, predicate, object, then qualifier pairs. Each topic's
facts are routed by their predicates; triples of a topic are merged by one conditional aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import timestamp_int, widened_end
from ..functions.text import is_item, rstrip_chars
from ..sources.service import Service

# Predicates for start, end, point in time, publication, inception and dissolution.
START, END, POINT, PUBLISHED, INCEPTION, DISSOLVED = "P580", "P582", "P585", "P577", "P571", "P576"
REFERENCE_END = "2050-12-31T00:00:00Z"
FACT = "array<struct<id:string,label:string>>"


def _ids(fact: Column) -> Column:
    return fact["id"]


def is_temporal(fact: Column) -> Column:
    # What is sought holds no line feed, so it lies in one id. Functions of arrays are compiled, lambdas are not.
    return F.contains(F.array_join(_ids(fact), "\n"), F.lit("T00:00:00Z"))


def unquoted(fact: Column) -> Column:
    quoted = F.contains(F.concat(F.array_join(_ids(fact), ""), F.array_join(fact["label"], "")), F.lit('"'))
    return F.when(quoted, F.transform(fact, lambda x: F.struct(F.replace(x["id"], F.lit('"'), F.lit("")).alias("id"), F.replace(x["label"], F.lit('"'), F.lit("")).alias("label")))).otherwise(fact)


def has(fact: Column, predicate: str) -> Column:
    return F.array_contains(_ids(fact), predicate)


def after_key(fact: Column, predicate: Column | str) -> Column:
    """The id that follows the last qualifier or predicate whose id contains ``predicate``."""
    key = F.lit(predicate) if isinstance(predicate, str) else predicate
    following = F.slice(_ids(fact), F.lit(2), F.size(fact))
    return F.try_element_at(F.filter(following, lambda v, i: v.isNotNull() & F.contains(F.get(_ids(fact), i), key)), F.lit(-1))


def last_timestamp(fact: Column) -> Column:
    return F.try_element_at(F.filter(_ids(fact), lambda x: F.contains(x, F.lit("T00:00:00Z"))), F.lit(-1))


def first_items(fact: Column) -> Column:
    """The items of a fact that count in templates and as answers: of longer facts the first five."""
    return F.when(F.size(fact) > 5, F.slice(fact, 1, 5)).otherwise(fact)


def template(short: Column) -> Column:
    """Labels without dates: the first three items, then qualifier pairs whose value is no date, of a fact's ``first_items``.

    Where the object of a qualified fact is a date, the characters of its predicate's label go off the end too.
    """
    date = lambda x: F.contains(x["id"], F.lit("T00:00:00Z"))
    kept = lambda items: F.filter(items, lambda x, i: ~date(F.when((i < 3) | (i % 2 == 0), x).otherwise(F.get(items, i + 1))))
    head = F.filter(F.slice(short, 1, 3), lambda x: ~date(x))
    tail = F.filter(short, lambda x, i: (i >= 3) & ~date(F.get(short, F.when(i % 2 == 1, i + 1).otherwise(i))))
    labels = lambda items: F.array_join(items["label"], " ")
    bare = F.concat(rstrip_chars(F.concat(F.lit(" "), labels(head)), F.get(short, F.lit(1))["label"]), F.lit(" "), labels(tail))
    return F.when((F.size(short) > 3) & date(F.get(short, F.lit(2))), F.trim(bare)).otherwise(labels(kept(short)))


def _told(fact: Column, short: Column, begin: Column, end: Column, rule: Column, answers: bool) -> dict[str, Column]:
    return {
        "rule": rule, "evidence_text": F.array_join(fact["label"], ", "), "candidate_question_text": template(short), "begin": begin, "end": end,
        "answer_ids": F.filter(_ids(short), lambda x: is_item(x) & (x != F.col("topic_id"))) if answers else F.array().cast("array<string>"), "entity_ids": F.filter(_ids(fact), is_item),
        "main_fact": F.get(fact, F.lit(0))["id"] == F.col("topic_id") if answers else F.lit(None).cast("boolean"),
    }


def _of_triples(triples: DataFrame, reference_end: str) -> DataFrame:
    fact = F.col("fact")
    said = lambda *span: [c.alias(name) for name, c in _told(fact, fact, *span, False).items()]
    triples = triples.withColumn("p", F.get(fact, F.lit(1))["id"]).withColumn("v", F.get(fact, F.lit(2))["id"])
    merged = triples.groupBy("topic_id").agg(*[F.max(F.when(F.col("p") == p, F.struct("fact_no", "fact", "v"))).alias(p) for p in (START, END, INCEPTION, DISSOLVED)])
    out = []
    for rule, a, b in (("triple_start_end", START, END), ("triple_inception", INCEPTION, DISSOLVED)):
        one = merged.where(F.col(a).isNotNull()).select("topic_id", F.col(f"{a}.fact_no").alias("fact_no"), F.col(f"{a}.fact").alias("fact"), F.col(f"{a}.v").alias("b"), widened_end(F.col(f"{b}.v"), reference_end).alias("e"))
        out.append(one.select("topic_id", "fact_no", *said(F.col("b"), F.col("e"), F.lit(rule))))
    without = triples.join(merged.where(F.col(INCEPTION).isNotNull()).select("topic_id"), "topic_id", "left_anti")
    v = F.col("v")
    out.append(without.select("topic_id", "fact_no", *said(v, widened_end(v), F.lit("triple_point"))))
    return reduce(DataFrame.unionByName, out)


def _qualified(read: DataFrame, reference_end: str, once: Callable[[Column], Column]) -> DataFrame:
    """``read (topic_id, fact_no, fact, n_items)`` with the evidence of facts of more than three items, step by step, as each is used several times."""
    fact, short, n, rule, key, begin = map(F.col, ("fact", "short", "n_items", "rule", "key", "begin"))
    rules = {"start_end": START, "point": POINT, "published": PUBLISHED}
    by = F.lit("last")
    for name, predicate in reversed(rules.items()):
        by = F.when(has(fact, predicate), name).otherwise(by)
    read = read.withColumns({"short": first_items(fact), "rule": F.when(n > 3, by)}).withColumn("key", F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[rule])
    read = read.select("*", once(F.when(rule == "last", last_timestamp(fact)).when(rule.isNotNull(), after_key(fact, key))).alias("begin"))
    end = F.when(rule == "start_end", widened_end(after_key(fact, END), reference_end)).otherwise(widened_end(begin))
    told = _told(fact, short, begin, end, rule, True)
    return read.select("topic_id", "fact_no", "n_items", F.when(n == 3, fact).alias("triple"), *[F.when(n > 3, c).alias(name) for name, c in told.items()])


def kb_evidence(facts: DataFrame, reference_end: str = REFERENCE_END, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Evidence of ``facts(topic_id, fact_no, fact)``, one row each: rule, text, template, span, answers, entities.

    Qualified facts: start with end, else point in time, else publication, else the last timestamp.
    Triples: start with end and inception with dissolution, each merged over the topic's triples, the last
    one winning; dated triples are points of their own if the topic has no inception. ``keep`` gets a table of one pass over the facts,
    in which triples are as they were read, and the triples' evidence: written, neither is worked out again where the evidence is used.
    """
    # Without a table in between, generators keep filters from working out anew what they test.
    once = (lambda c: c) if keep else (lambda c: F.explode(F.array(c)))
    fact = F.col("fact")
    read = facts.select("topic_id", "fact_no", once(unquoted(fact)).alias("fact")).withColumn("n_items", F.when(is_temporal(fact), F.size(fact)))
    if keep:
        kept = keep(_qualified(read, reference_end, once))
        qualified, triples = kept.where("n_items > 3"), kept.where("n_items = 3").select("topic_id", "fact_no", F.col("triple").alias("fact"))
        of_triples = keep(_of_triples(triples, reference_end))
    else:
        qualified, triples = _qualified(read.where("n_items > 3"), reference_end, once), read.where("n_items = 3").select("topic_id", "fact_no", "fact")
        of_triples = _of_triples(triples, reference_end)
    out = qualified.drop("n_items", "triple").unionByName(of_triples)
    return out.where("begin is not null").withColumns({"start_time_int": timestamp_int(F.col("begin")), "end_time_int": timestamp_int(F.col("end"))})


def facts_of(entities: DataFrame, facts: DataFrame | Service, most: int = 1000) -> DataFrame:
    """Facts ``(fact_id, fact)`` that name an entity of ``entities(topic_id)`` in any place: ``(topic_id, fact_no, fact)``, the first ``most`` of each by fact_id.

    Facts are numbered from 1. Spark's limit on row_number cuts each task's share of an entity to ``most`` before the shuffle.
    A service gives ``(topic_id, fact_id, fact)`` of each entity that it is asked for.
    """
    if isinstance(facts, Service):
        met = facts.rows(entities.select("topic_id"))
    else:
        named = facts.select("fact_id", "fact", F.explode(F.array_distinct(F.transform("fact", lambda x: x["id"]))).alias("topic_id"))
        met = named.join(entities.select("topic_id").distinct(), "topic_id")
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("fact_id"))
    return met.withColumn("fact_no", rank).where(F.col("fact_no") <= most).select("topic_id", "fact_no", "fact")

"""The way from facts to questions does each step once, over no more rows than it needs."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import predicates
from chronoweave.operators import kb, questions
from chronoweave.plans import generate, registry
from chronoweave.session import stored

from . import golden

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp"


@pytest.mark.parametrize("name", ["questions_of_orders", "finished_of_orders"])
def test_repeated_orders_are_no_more_questions_than_in_sql(spark, tmp_path, name):
    """An order that is there twice is two mains and two constraints, and not more by joins of the rows with themselves."""
    day = lambda d: datetime(1995, 3, d)
    rows = [(1, 1, day(2)), (1, 1, day(2)), (2, 1, day(3)), (3, 1, day(3)), (4, 1, day(4)), (5, 2, day(9)), (6, 2, day(9)), (6, 2, day(9)), (7, 3, None), (8, 3, day(1)), (9, None, day(1)), (10, None, day(1))]
    spark.createDataFrame(rows, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(map(tuple, found.select(names).collect())) == sorted(expected) and expected


def _facts(spark, rows=golden._FACTS):
    return spark.createDataFrame(rows, f"topic_id string, fact_no int, fact {kb.FACT}")


def test_facts_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    facts = _facts(spark)
    found = generate.fact_evidence(facts.mapInArrow(counted, facts.schema), *_names(spark))
    assert found.count() == 8
    assert seen.value == len(golden._FACTS)


def _names(spark):
    return spark.createDataFrame([("Q2", ["Bob"])], "id string, labels array<string>"), spark.createDataFrame([("Q2", "human", [1])], "id string, type string, frequency array<bigint>")


def test_kept_facts_are_the_same_evidence(spark):
    """Quotes go, longer facts count by five items, several qualifiers by the first rule; facts without a date or of two items tell nothing."""
    at, more = "2001-05-04T00:00:00Z=4 May 2001", ["P1=x", "Q9=more"]
    odd = [
        ("Q1", 11, golden._fact("Q1=Ann", 'P1="x"', "Q4=Y", "P585=at", '"2001-05-04T00:00:00Z"=4 May 2001')), ("Q1", 12, golden._fact("Q1=Ann", "P1=x", "Q4=Y", "P577=out", "1990-01-01T00:00:00Z=1990", "P585=at", at)),
        ("Q1", 13, golden._fact("Q1=Ann", "P1=made on", at, *more, "P585=at", at)), ("Q2", 14, golden._fact("Q1=Ann", "P1=x", "Qx=Y", *more, "P585=at")), ("Q1", 15, golden._fact("Q1=Ann", at)), ("Q1", 16, None), (None, 17, golden._fact("Q1=Ann", "P1=x", "Q4=Y", "P99=at", at)),
    ]
    facts = _facts(spark, golden._FACTS + odd)
    kept = kb.kb_evidence(facts, keep=lambda df: stored(df, "kept")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, kb.kb_evidence(facts).collect()))
    told = {r["fact_no"]: r for r in kept if r["fact_no"] > 10}
    assert {k: (r["rule"], r["candidate_question_text"], r["start_time_int"], r["answer_ids"], r["entity_ids"]) for k, r in told.items()} == {
        11: ("point", "Ann x Y", 20010504, ["Q4"], ["Q1", "Q4"]), 12: ("point", "Ann x Y", 20010504, ["Q4"], ["Q1", "Q4"]),
        13: ("point", "A x more", 20010504, ["Q9"], ["Q1", "Q9"]), 17: ("last", "Ann x Y", 20010504, [], ["Q1", "Q4"]),
    }


def test_only_mains_that_share_a_constraint_are_embedded(spark):
    """Two orders of neighbouring days are questions of each other; with a third the first two share a constraint."""

    def evidence(*days):
        who = ("Q1", "C1", "client", None)
        rows = [(f"Q1:kb:{i}:point", "Q1", "kb", "entity", 0, f"C1, made, O{i}", f"C1 made O{i}", 19950300 + d, 19950300 + d, [who, (f"Q{i + 10}", f"O{i}", "order", None)], True) for i, d in enumerate(days)]
        return spark.createDataFrame(rows, generate.EVIDENCE)

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        seen.add(1)
        return [1.0, 2.0]

    two = generate.pseudo_questions(evidence(2, 4), embed, need_similar=False).collect()
    assert len(two) == 2 and seen.value == 0
    three = {(r["main_id"][6], r["constraint_id"][6]): r["similar"] for r in generate.pseudo_questions(evidence(2, 4, 3, 20, 21), embed, need_similar=False).collect()}
    assert {k: [c["main_id"][6] for c in v] for k, v in three.items() if v} == {("0", "1"): ["2"], ("1", "0"): ["2"]}
    assert seen.value == 3 and len(three) == 8


def test_entities_of_evidence_in_order_each_once(spark):
    """An entity stands at its first place, under its last mention; a repeated row of a dimension adds none."""
    rows = spark.createDataFrame([("e",), ("e",), ("f",), ("none",)], "evidence_id string")
    mentions = spark.createDataFrame([("e", "Q2", 7, "Bobby"), ("e", "Q1", 3, "Ann"), ("e", "Q2", 1, "Bob"), ("f", "Q9", 0, None)], "evidence_id string, id string, place int, mention string")
    labels, entities = _names(spark)
    got = generate._with_entities(rows, mentions, labels.unionByName(labels), entities.unionByName(entities)).collect()
    assert sorted((r["evidence_id"], *[tuple(x) for x in r["entities"]]) for r in got) == [("e", ("Q2", "Bob", "human", "Bobby"), ("Q1", "Q1", "NULL", "Ann"))] * 2 + [("f", ("Q9", "Q9", "NULL", None))]


def test_hubs_of_one_slot_are_told_apart(spark, monkeypatch):
    """Entities that share a slot are counted one by one."""
    monkeypatch.setattr(questions, "HUB_SLOTS", 1)
    rows = lambda **n: spark.createDataFrame([(k,) for k, m in n.items() for _ in range(m)] + [(None,)] * 9, "entity string")
    assert [r["entity"] for r in questions._hubs(rows(a=3, b=2, d=9), rows(a=3, b=2, c=9), 8).collect()] == ["a"]
    assert questions._hubs(rows(a=3), rows(a=3), 9) is None


def test_marks_of_facts_by_words(spark):
    """A form within a longer word is none."""
    texts = ["Ann died", "He diedx", "dead-end", "She was born.", "newborn", "spouses", "spousex", "birthdate 1990", "birthdates", "", None, "Date of Death", "forbear"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.array(*predicates.fact_marks("t")).alias("m")).collect()
    told = {texts[r["i"]]: [j for j, x in enumerate(r["m"]) if x] for r in got}
    assert told == {"Ann died": [0], "He diedx": [], "dead-end": [0], "She was born.": [1], "newborn": [], "spouses": [2], "spousex": [], "birthdate 1990": [4], "birthdates": [], "": [], None: [], "Date of Death": [0, 3], "forbear": []}

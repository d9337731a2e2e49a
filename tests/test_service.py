"""Dimensions behind services: batches, retries, equal rows by table and by service, and the data source."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import kb, link, questions, records
from chronoweave.sources.service import Service, dimension, redirect_service, register_service


def noting(path, table):
    """A provider that looks keys up in ``table`` and notes each call."""

    def provider(keys):
        import uuid

        Path(path, uuid.uuid4().hex).write_text("\n".join(keys))
        return [(k, table[k]) for k in keys if k in table]

    return provider


def calls(path):
    return [p.read_text().split("\n") for p in Path(path).iterdir()]


def test_keys_go_once_in_batches(spark, tmp_path):
    known = {f"k{i}": i for i in range(0, 120, 2)}
    keys = spark.range(120).select(F.concat(F.lit("k"), "id").alias("key")).repartition(1)
    keys = keys.unionByName(keys).unionByName(spark.createDataFrame([(None,), ("",)], "key string"))
    service = Service("key string, n int", noting(str(tmp_path), known))
    got = dimension(service, keys)
    for _ in range(2):  # what is read twice is asked once
        assert {(r["key"], r["n"]) for r in got.collect()} == set(known.items())
    asked = [k for c in calls(tmp_path) for k in c]
    assert sorted(asked) == sorted({"", *(f"k{i}" for i in range(120))}) and max(map(len, calls(tmp_path))) <= 50
    assert dimension(service, keys.limit(0)).count() == 0
    table = spark.createDataFrame(list(known.items()), "key string, n int")
    assert dimension(table, keys) is table


def test_failures_are_tried_again_and_raised(spark, tmp_path):
    def once_down(keys):
        mark = Path(str(tmp_path), "down-" + keys[0])
        if not mark.exists():
            mark.touch()
            raise OSError("down")
        return [(k, 1) for k in keys]

    def down(keys):
        raise OSError("down")

    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert Service("key string, n int", once_down, pause=0).rows(keys).count() == 2
    assert Service("key string, n int", down, attempts=2, pause=0, skip_failed=True).rows(keys).count() == 0
    with pytest.raises(Exception, match="down"):
        Service("key string, n int", down, attempts=1).rows(keys)


def test_redirects_after_normal_forms(spark, tmp_path):
    """Only unknown paths are asked; a path is normalised, then redirected, and two forms of one title both are."""

    def respond(paths):
        Path(str(tmp_path), "-".join(p.strip("_") for p in paths)[:60]).write_text("\n".join(paths))
        titles = {p: p.replace("_", " ").strip() for p in paths}
        moved = {"Big Apple": "New York's City", "Plain": "Rome"}
        return {"normalized": [{"from": p, "to": t} for p, t in titles.items() if t != p], "redirects": [{"from": f, "to": t} for f, t in moved.items() if f in titles.values()]}

    paths = spark.createDataFrame([("Rome", "Q1"), ("New_York%27s_City", "Q2"), ("Known", "Q3")], "path string, id string")
    rows = spark.createDataFrame([(1, "Big_Apple"), (2, "Big_Apple_"), (3, "Plain"), (4, "Known"), (5, "Nothing"), (6, None), (7, "Kn.own"), (8, "Big_Apple")], "n int, path string")
    by_service = link.resolve_paths(rows, paths, redirect_service(respond)).orderBy("n").collect()
    table = spark.createDataFrame([("Big_Apple", "New York's City"), ("Big_Apple_", "New York's City"), ("Plain", "Rome")], "from_path string, to_title string")
    assert by_service == link.resolve_paths(rows, paths, table).orderBy("n").collect()
    assert [r["id"] for r in by_service] == ["Q2", "Q2", "Q1", "Q3", None, None, "Q3", "Q2"]
    assert sorted(p for c in calls(tmp_path) for p in c) == ["Big_Apple", "Big_Apple_", "Nothing", "Plain"]


def test_types_labels_and_facts_by_service_equal_those_by_table(spark):
    rows = spark.createDataFrame([("Q1",), ("Q2",), ("Q9",), (None,), ("Q1",)], "id string")
    types = {"Q1": ("town", [1, 2]), "Q2": (None, None)}
    labels = {"Q1": ["Q1", "Rome"], "Q2": ["Oslo"]}
    entities = spark.createDataFrame([(k, *v) for k, v in types.items()], "id string, type string, frequency array<bigint>")
    names = spark.createDataFrame(list(labels.items()), "id string, labels array<string>")
    typed = Service("id string, type string, frequency array<bigint>", lambda ks: [(k, *types[k]) for k in ks if k in types])
    named = Service("id string, labels array<string>", lambda ks: [(k, labels[k]) for k in ks if k in labels])
    key = lambda r: str(r["id"])
    assert sorted(link.with_types(rows, typed).collect(), key=key) == sorted(link.with_types(rows, entities).collect(), key=key)
    assert sorted(link.with_labels(rows, named).collect(), key=key) == sorted(link.with_labels(rows, names).collect(), key=key)

    item = lambda i: {"id": i, "label": i}
    told = [(n, [item(t), item("P1"), item(f"Q{n}")]) for n, t in enumerate(["Q1", "Q2", "Q1", "Q1"], 10)]
    facts = spark.createDataFrame(told, f"fact_id long, fact {kb.FACT}")
    of = Service(f"topic_id string, fact_id long, fact {kb.FACT}", lambda ks: [(k, n, f) for k in ks for n, f in told if any(x["id"] == k for x in f)])
    asked = rows.withColumnRenamed("id", "topic_id")
    one, two = (sorted(kb.facts_of(asked, x, 2).collect()) for x in (of, facts))
    assert one == two and [(r["topic_id"], r["fact_no"]) for r in one] == [("Q1", 1), ("Q1", 2), ("Q2", 1)]


def test_service_as_data_source(spark, tmp_path):
    register_service(spark, "names", Service("id string, n int", noting(str(tmp_path), {f"Q{i}": i for i in range(200)})))
    source = lambda: spark.read.format("names").load()
    many = source().where(F.col("id").isin(*[f"Q{i}" for i in range(120)], "X") & (F.col("n") > 100))
    assert sorted(r["n"] for r in many.collect()) == list(range(101, 120))
    assert sorted(map(len, calls(tmp_path))) == [21, 50, 50]
    assert [r["n"] for r in source().where("id = 'Q7'").collect()] == [7]
    assert source().where("id = 'Q7' and id in ('Q8', 'Q9')").count() == 0
    with pytest.raises(Exception, match="read by its key"):
        source().count()


def test_numbered_evidence(spark):
    entity = spark.createDataFrame([(3, "c"), (1, "a")], "k int, text string")
    year = spark.createDataFrame([(2, 1999), (0, None)], "k int, year int")
    got = records.numbered_evidence(entity, year, 4, "k").collect()
    assert sorted((r["evidence_id"], r["evidence_type"], r["k"], r["text"], r["year"]) for r in got) == [("4-1", "entity_page", 1, "a", None), ("4-2", "entity_page", 3, "c", None), ("4-3", "year_page", 0, None, None), ("4-4", "year_page", 2, None, 1999)]
    assert records.numbered_evidence(entity.limit(0), year.limit(0), 4, "k").count() == 0


def test_slots_of_similar_questions(spark):
    """Each similar question's main slot goes behind the first one, so the last comes first."""
    like = "array<struct<main_id:string,answers:array<string>,spans:array<string>,ids:array<string>>>"
    rows = [
        ("m", ["A"], ["s", "z"], ["Q1"], [("n", ["B"], ["t", "z"], ["Q1", "Q2"]), ("o", ["A", "C"], ["u", "z"], ["Q3"])]),
        ("p", ["A"], ["s", "z"], ["Q1"], None), ("q", ["A"], ["s"], [], []), ("r", ["A"], [], ["Q1"], []),
    ]
    df = spark.createDataFrame(rows, f"main_id string, answers array<string>, spans array<string>, ids array<string>, similar {like}")
    got = questions.with_slots_of_similar(df, ("spans",), entities="ids").orderBy("main_id").collect()
    assert [(r["answers"], r["spans"], r["ids"], r["main_ids"]) for r in got] == [
        (["A", "B", "A", "C"], ["s", "u", "t", "z"], ["Q1", "Q2", "Q3"], ["m", "n", "o"]), (["A"], ["s", "z"], ["Q1"], ["p"]), (["A"], ["s"], [], ["q"]), (["A"], [], ["Q1"], ["r"]),
    ]

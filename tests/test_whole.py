"""Registered queries read their tables and texts whole: small tables against brute force in Python."""

import re
import string

from pyspark.sql import functions as F

from chronoweave.functions import predicates, relations
from chronoweave.plans import registry

DATA = "/root/testdata/sf0.001"


def run(spark, path, name, **tables):
    """The query's rows over ``tables``, (rows, schema) each."""
    for k, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{k}.parquet")
    return registry.queries()[name](spark, str(path)).collect()


def test_no_relation_reads_whole_texts(spark, tmp_path):
    stop = "it was on and off for him and for her, as before "  # longer than 40 characters
    texts = [stop, stop + "Paris", stop * 9 + "!", stop * 400 + "Paris", "Paris " + stop, "the the of", "", " ", None]
    got = run(spark, tmp_path, "no_relation", documents=(list(enumerate(texts)), "doc_id long, text string"))
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = registry.queries()["no_relation"](spark, DATA).collect()

    def empty(t):
        bare = "".join(c for c in t.replace("the ", "") if c not in string.punctuation)
        return not set(re.split(r"[ \t-\r]+", bare.lower())) - set(predicates.STOPWORDS) - {""}

    assert {r["doc_id"]: r["empty_relation"] for r in got} == {i: empty(t) for i, t in enumerate(texts) if t is not None}
    assert [empty(t) for t in texts[:4]] == [True, False, True, False]
    assert {r["doc_id"]: r["empty_relation"] for r in found} == {r["doc_id"]: empty(r["text"]) for r in real if r["text"] is not None}


def test_year_signals_pairs_all_orders(spark, tmp_path):
    """Every pair of a customer's orders is counted; one call for each pair gives its signal."""
    from datetime import date

    orders = [(k, k % 4, date(1995 + k * 7 % 5, 3, 1 + k)) for k in range(1, 25)]
    items = [(k, k % 3 + 1, d) for k, _, d in orders]
    got = run(spark, tmp_path, "year_signals", orders=(orders, "o_orderkey long, o_custkey long, o_orderdate date"), lineitem=(items, "l_orderkey long, l_suppkey long, l_shipdate date"))
    span = lambda k, d: (d.year * 10000 + 101, d.year * 10000 + (1231 if k % 2 == 0 else 11231))
    pairs = [(m, *span(m, d), *span(c, o)) for m, x, d in orders for c, y, o in orders if x == y and m != c]
    told = spark.createDataFrame(pairs, "m long, b int, e int, cs int, ce int").select("m", F.coalesce(relations.signal(*map(F.col, ("b", "e", "cs", "ce"))), F.lit("none")).alias("s")).collect()
    assert {r["signal"]: (r["n"], r["main_sum"]) for r in got} == {s: (len(x := [r["m"] for r in told if r["s"] == s]), sum(x)) for s in {r["s"] for r in told}}
    assert sum(r["n"] for r in got) == len(pairs) == 4 * 6 * 5


LONG = "the band that toured the whole country "  # longer than 30 characters


def test_posed_questions_are_read_whole(spark, tmp_path):
    """What stands beyond character 30 of a conversation's text decides, and all of its words count."""
    # (conv_id + turn) % 8 gives the beginning: 1 "Which album came out in 1999 after ", 2 "How many people saw ", 3 "What yearly festival came after ", 4 "When did Ann marry before "
    rows = [
        (3, 0, LONG + "and how many came?"), (3, 8, LONG + "in which year?"), (3, 16, LONG + "and that is all"), (4, 0, "a b c"),
        (19, 0, LONG + "- after 1999"), (11, 9, None), (4, 9, "incomprehensibilities internationalization z z"),
    ]
    schema = "conv_id long, turn long, text string"
    flaws = run(spark, tmp_path, "question_filters", conversations=(rows, schema))
    assert {(r["conv_id"], r["turn"]): r["flaw"] for r in flaws} == {(3, 0): "number", (3, 8): "time", (3, 16): None, (4, 0): "time", (19, 0): None, (11, 9): "short", (4, 9): "strange"}
    signals = run(spark, tmp_path, "signal_check")
    assert {(r["conv_id"], r["turn"]): (r["asks_time"], r["kept"]) for r in signals}[3, 8] == (True, None)


def test_kept_signals_are_read_whole(spark, tmp_path):
    # Turn % 3: 0 OVERLAP, 1 AFTER. (conv_id + turn) % 8 = 2: "How many people saw ".
    rows = [(2, 0, LONG + "again after it"), (2, 24, LONG + "again"), (1, 1, LONG + "in the year of it"), (9, 1, LONG + "again"), (1, 25, LONG + "and when")]
    got = run(spark, tmp_path, "signal_check", conversations=(rows, "conv_id long, turn long, text string"))
    assert {(r["conv_id"], r["turn"]): (r["asks_time"], r["kept"]) for r in got} == {(2, 0): (False, False), (2, 24): (False, True), (1, 1): (False, False), (9, 1): (False, True), (1, 25): (True, False)}


def test_snippets_of_all_languages(spark, tmp_path):
    rows = [(1, "One. Two is longer! Three?", "en"), (2, "Un. Deux est plus long! Trois?", "fr"), (3, "Eins.\nZwei.", "de"), (4, "No language. None.", None), (5, "", "en"), (6, None, "es")]
    got = run(spark, tmp_path, "text_snippets", documents=(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"]: (r["n"], r["longest"]) for r in got} == {1: (3, 14), 2: (3, 19), 3: (2, 5), 4: (2, 12)}


def test_sentences_keep_their_digits(spark, tmp_path):
    """A sentence loses blanks, not the digits of its number in the text."""
    from chronoweave.functions import text

    said = [f"{i} men, {i}" + "!" * (i % 2) + "." for i in range(30)]
    got = run(spark, tmp_path, "text_snippets", documents=([(i, " ".join(said[: i + 1])) for i in range(30)], "doc_id long, text string"))
    assert {r["doc_id"]: (r["n"], r["longest"]) for r in got} == {i: (i + 1, max(map(len, said[: i + 1]))) for i in range(30)}
    assert list(spark.range(1).select(text.sentences(F.lit("Ann left!  (0) She came?  \u00c9 1. Ends in 3")).alias("s")).first()["s"]) == ["Ann left!", "(0) She came?", "\u00c9 1.", "Ends in 3"]


def test_shops_of_four_digits_are_no_years(spark, tmp_path):
    keys = [7, 999, 1000, 1920, 9999, 10000]
    tables = {"supplier": ([(k, f"S{k}", k % 2) for k in keys], "s_suppkey long, s_name string, s_nationkey long"), "nation": ([(0, "EAST"), (1, "WEST")], "n_nationkey long, n_name string")}
    got = run(spark, tmp_path, "evidence_of_suppliers", **tables)
    want = {f"Q{k}:text:0": (f"S{k}, {'WEST' if k % 2 else 'EAST'} got shop {k}.", (1900 + k % 100) * 10000 + 101, (1900 + k % 100) * 10000 + 1231) for k in keys}
    assert {r["evidence_id"]: (r["template"], r["begin_day"], r["end_day"]) for r in got} == want

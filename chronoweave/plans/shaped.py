"""Queries over rows of the driver's tables that are shaped as sentences, pages, facts and evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, predicates, text, tokens
from ..operators import annotate, generators, kb, link, ordinals, questions, signals
from ..sources import html
from .star import Query, spread, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _key() -> Column:
    return F.col("o_orderkey").cast("string")


@query("""SELECT o_orderkey, 'first=1@4-9,' || o_orderkey || 'th=' || o_orderkey || '@' || (27 + length(c)) || '-' || (29 + length(c) + length(o_orderkey::VARCHAR)) || ',thirty-second=32@' || (38 + length(c) + length(o_orderkey::VARCHAR)) || '-' || (51 + length(c) + length(o_orderkey::VARCHAR)) AS found
FROM (SELECT o_orderkey, o_clerk AS c FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS o_clerk FROM orders))""")
def ordinals_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _said("The first man of the year ", F.date_format("o_orderdate", "yyyy"), " ", _key(), "th and his thirty-second, on 2nd March.")
    found = F.transform(ordinals.annotate_ordinals(said), lambda x: _said(x["text"], "=", x["ordinal"].cast("string"), "@", x["s"].cast("string"), "-", x["e"].cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("found"))


_SAID = """SELECT o_orderkey, o_orderkey % 4 AS k, strftime(o_orderdate, '%Y') AS y, (year(o_orderdate) + 3)::VARCHAR AS z, CASE o_orderkey % 4 WHEN 0 THEN 'before ' WHEN 1 THEN 'since ' WHEN 2 THEN 'from ' ELSE '' END AS w FROM orders"""


def _signalled() -> Column:
    k, y = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy")
    until = F.when(k == 2, _said(" to ", (F.year("o_orderdate") + 3).cast("string"))).otherwise("")
    return _said("It sold ", F.when(k == 0, "before ").when(k == 1, "since ").when(k == 2, "from ").otherwise(""), y, until, ", the first time.")


@query(f"""WITH s AS ({_SAID})
SELECT o_orderkey, CASE k WHEN 0 THEN 'before ' || y || '=BEFORE' WHEN 1 THEN 'since ' || y || '=START' WHEN 2 THEN y || ' to ' || z || '=DURATION' ELSE y || '=No signal' END AS found, y || '-01-01T00:00:00Z' AS begin_ts, CASE k WHEN 2 THEN z ELSE y END || '-12-31T00:00:00Z' AS end_ts FROM s""")
def signals_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    x = rows.select("o_orderkey", F.explode(signals.explicit_expressions(_signalled())).alias("x"))
    return x.select("o_orderkey", _said(F.col("x.text"), "=", F.col("x.signal")).alias("found"), F.col("x.begin").alias("begin_ts"), F.col("x.end").alias("end_ts"))


# What is said before an order's year, how much of it counts as a keyword, and the signal: inflected, nouns and verbs in -ing, closer keywords, none.
_FORMS = [
    ("was preceded by", "by", "FINISH"), ("had begun", "begun", "START"), ("starts", "starts", "START"), ("was opening", "opening", "START"), ("in  the years", "in  the years", "OVERLAP"), ("no later than", "later than", "AFTER"),
    ("at the ends of", "at the ends of", "FINISH"), ("at the beginning of", "at the beginning of", "START"), ("had the ending in", "in", "OVERLAP"), ("ended", "ended", "FINISH"), ("precedes", "", "No signal"), ("is", "", "No signal"),
    ("liked the beginning", "", "No signal"), ("Prior to", "Prior to", "BEFORE"), ("wasbefore", "", "No signal"), ("before,", "", "No signal"),
]


@query(f"""WITH v(k, w, c, signal) AS (VALUES {', '.join(f"({i}, '{w}', '{c}', '{s}')" for i, (w, c, s) in enumerate(_FORMS))})
SELECT o_orderkey, c || CASE WHEN c = '' THEN '' ELSE ' ' END || year(o_orderdate) AS found, signal, nullif(c, '') AS signal_text, 5 + length(w) - length(c) + CASE WHEN c = '' THEN 1 ELSE 0 END AS s FROM orders JOIN v ON k = o_orderkey % {len(_FORMS)}""")
def keywords_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    said = _said("They ", F.get(F.array(*[F.lit(w) for w, _, _ in _FORMS]), (F.col("o_orderkey") % len(_FORMS)).cast("int")), " ", F.date_format("o_orderdate", "yyyy"), " men.")
    told = rows.select("o_orderkey", said.alias("t")).select("o_orderkey", "t", dates.annotate_dates(F.col("t")).alias("d"), tokens.tokenizer(tokens.lemma_model(signals.lemmas_of(signals.KEYWORDS)))(F.col("t")).alias("k"))
    x = told.select("o_orderkey", F.explode(signals.explicit_expressions(F.col("t"), F.col("d"), tokens=F.col("k"))).alias("x"))
    return x.select("o_orderkey", F.col("x.text").alias("found"), "x.signal", "x.signal_text", "x.s")


@query(f"""WITH s AS ({_SAID}), p AS (SELECT *, 8 + length(w) AS a, CASE WHEN k = 2 THEN 2 ELSE 1 END AS n, 8 + length(w) + CASE WHEN k = 2 THEN 12 ELSE 4 END AS e FROM s)
SELECT o_orderkey, 0 AS id, 'date' AS type, y AS mention, '' AS signal, a AS s, a + 4 AS e, '' AS nest FROM p
UNION ALL SELECT o_orderkey, 1, 'date', z, '', a + 8, a + 12, '' FROM p WHERE k = 2
UNION ALL SELECT o_orderkey, n, 'ordinal', 'first', 'ORDINAL', e + 6, e + 11, '' FROM p
UNION ALL SELECT o_orderkey, n + 1, 'explicit', CASE WHEN k = 2 THEN y || ' to ' || z ELSE w || y END, CASE k WHEN 0 THEN 'BEFORE' WHEN 1 THEN 'START' WHEN 2 THEN 'DURATION' ELSE 'No signal' END, CASE WHEN k = 2 THEN a ELSE 8 END, e, CASE WHEN k = 2 THEN '0,1' ELSE '0' END FROM p""")
def annotations_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    x = rows.select("o_orderkey", F.inline(annotate.annotations(_signalled())))
    return x.select("o_orderkey", "id", "type", "mention", "signal", "s", "e", F.array_join(F.transform("nest", lambda i: i.cast("string")), ",").alias("nest"))


@query("""SELECT l_orderkey, s AS source, CASE s WHEN 'text' THEN n = 1 AND NOT b ELSE n <= 2 END AS kept FROM (
  SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'text' ELSE 'info' END AS s, count(DISTINCT l_shipdate) AS n, bool_or(l_linestatus = 'F' AND l_returnflag = 'R') AS b FROM lineitem GROUP BY l_orderkey)""")
def snippets_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "BEFORE").otherwise("OVERLAP")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_shipdate").alias("spans"), F.collect_set(signal).alias("signals"))
    source = F.when(F.col("l_orderkey") % 2 == 0, "text").otherwise("info")
    return held.select("l_orderkey", source.alias("source"), predicates.snippet_kept(source, F.col("spans"), F.col("signals")).alias("kept"))


_THEMES = "CASE o_orderkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"


@query(f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey % 3 AS c FROM orders)
SELECT o_orderkey, {_THEMES.format("TRUE", "c <= 1", "c <= 1", "FALSE", "c <= 1 AND o_orderkey % 2 = 0")} AS same FROM o""")
def same_facts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    pick = lambda *a: F.when(k % 5 == 0, a[0]).when(k % 5 == 1, a[1]).when(k % 5 == 2, a[2]).when(k % 5 == 3, a[3]).otherwise(a[4])
    a = pick("Ann died in Rome", "Ann was born", "Ann spouse Bob", "Ann died in Rome", "Ann sang")
    z = pick("Ann, date of death, 1999", "Bob was born too", "spouses Ann and Bob", "Ann was born", "Bob sang")
    # The other snippet's dates are 0, 1 or 2 from these; near dates with equal items are one fact, so only case 4 has them.
    b, other = year, year + F.col("o_custkey") % 3
    ids = F.array(F.lit("Q1"), F.lit("2000-01-01T00:00:00Z"))
    others = F.when((k % 5 == 4) & (k % 2 == 0), F.array(F.lit("Q1"))).otherwise(F.array(F.lit("Q2")))
    return table(spark, sf_dir, "orders").select("o_orderkey", predicates.same_fact(a, z, b, b, other, other, ids, others).alias("same"))


_FACTS = """WITH o AS (SELECT o_orderkey AS k, 'Q' || o_custkey AS t, 'C' || o_custkey AS c, 'Q9' || o_orderkey AS a, strftime(o_orderdate, '%Y%m%d')::INT AS d, (strftime(o_orderdate, '%Y') || '0101')::INT AS y, (strftime(o_orderdate, '%Y') || '1231')::INT AS z FROM orders)"""


@query(f"""{_FACTS}
SELECT t AS topic_id, k AS fact_no, CASE k % 4 WHEN 0 THEN 'start_end' WHEN 1 THEN 'point' WHEN 2 THEN 'published' ELSE 'last' END AS rule, c || ' made O' || k AS template, CASE k % 4 WHEN 0 THEN d ELSE y END AS begin_day,
  CASE k % 4 WHEN 0 THEN 20501231 ELSE z END AS end_day, a AS answers, c || ', made, O' || k || ', at, x' AS evidence_text FROM o""")
def facts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    qualifier = F.when(k % 4 == 0, kb.START).when(k % 4 == 1, kb.POINT).when(k % 4 == 2, kb.PUBLISHED).otherwise("P99")
    at = _said(F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-01-01")), "T00:00:00Z")
    pair = lambda i, name: F.struct(i.alias("id"), name.alias("label"))
    who, what = F.col("o_custkey").cast("string"), _key()
    fact = F.array(pair(_said("Q", who), _said("C", who)), pair(F.lit("P1"), F.lit('"made"')), pair(_said("Q9", what), _said("O", what)), pair(qualifier, F.lit("at")), pair(at, F.lit("x")))
    found = kb.kb_evidence(table(spark, sf_dir, "orders").select(_said("Q", who).alias("topic_id"), k.alias("fact_no"), fact.alias("fact")))
    return found.select("topic_id", "fact_no", "rule", F.col("candidate_question_text").alias("template"), F.col("start_time_int").alias("begin_day"), F.col("end_time_int").alias("end_day"), F.array_join("answer_ids", ",").alias("answers"), "evidence_text")


@query("""SELECT topic_id, fact_no, l_orderkey, l_linenumber FROM (SELECT 'Q' || l_suppkey AS topic_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS fact_no, l_orderkey, l_linenumber FROM lineitem) WHERE fact_no <= 20 AND topic_id <> 'Q3'""")
def facts_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    pair = lambda x: F.struct(x.cast("string").alias("id"), x.cast("string").alias("label"))
    facts = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.array(pair(F.col("l_orderkey")), pair(F.lit("P1")), pair(_said("Q", F.col("l_suppkey").cast("string"))), pair(F.col("l_linenumber"))).alias("fact"))
    asked = table(spark, sf_dir, "supplier").where("s_suppkey <> 3").select(_said("Q", F.col("s_suppkey").cast("string")).alias("topic_id"))
    met = kb.facts_of(asked, facts, 20)
    return met.select("topic_id", "fact_no", F.get("fact", F.lit(0))["id"].cast("long").alias("l_orderkey"), F.get("fact", F.lit(3))["id"].cast("int").alias("l_linenumber"))


@query("""SELECT s_suppkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Q' || n_nationkey END AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def reconciled_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    hit = lambda rank, name: nation.select(_said("u/", F.col("n_nationkey").cast("string")).alias("url"), F.lit(rank).alias("rank"), _said("Q", F.col("n_nationkey").cast("string")).alias("id"), name.alias("name"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _said("u/", F.col("s_nationkey").cast("string")).alias("url"))
    return link.reconciled(rows, hit(1, F.lit("other")).unionByName(hit(0, F.col("n_name")))).select("s_suppkey", "id", "name")


_PAGE = ('<div class="navbox"><a href="/wiki/Nav">Navigation</a></div><table class="infobox"><tr><th>Home</th></tr><tr><th>Nation</th><td><a href="/wiki/', '">', "</a></td></tr><tr><th>Key</th><td>", "<br>of ", '</td></tr></table><a href="/wiki/File:x">A file</a><a href="/wiki/S', '">Supplier ', "</a>")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path, key = F.translate("n_name", " ", "_"), F.col("s_suppkey").cast("string")
    return rows.select("s_suppkey", _said(_PAGE[0], path, _PAGE[1], F.col("n_name"), _PAGE[2], key, _PAGE[3], F.col("n_name"), _PAGE[4], key, _PAGE[5], key, _PAGE[6]).alias("html"))


@query("""SELECT s_suppkey, unnest([0, 2]) AS pos, unnest([n_name, 'Supplier ' || s_suppkey]) AS text, unnest(['/wiki/' || replace(n_name, ' ', '_'), '/wiki/S' || s_suppkey]) AS href FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def anchors_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_anchors(_pages(spark, sf_dir), "s_suppkey")


@query("""SELECT s_suppkey, unnest([1, 2]) AS row, unnest(['Home, Nation, ' || n_name, 'Home, Key, ' || s_suppkey || ', of ' || n_name]) AS evidence_text, n_name || '>' || replace(n_name, ' ', '_') AS links FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def infobox_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.infobox_evidence(_pages(spark, sf_dir), "s_suppkey")
    return found.select("s_suppkey", "row", "evidence_text", F.array_join(F.transform("links", lambda x: _said(x["text"], ">", x["path"])), ",").alias("links"))


@query("""SELECT p_partkey, 'M@' || p_name || '@0-' || length(p_name) || ',B@' || p_brand || '@' || (length(p_name) + 4) || '-' || (length(p_name) + 4 + length(p_brand)) AS links FROM part""")
def links_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    anchor = lambda i, t, p: F.struct(F.lit(i).alias("pos"), t.alias("text"), F.lit(p).alias("path"))
    known = F.array(anchor(0, F.substring("p_name", 1, 5), "short"), anchor(1, F.col("p_brand"), "B"), anchor(2, F.col("p_name"), "M"), anchor(3, F.lit("of"), "x#y"), anchor(4, F.lit("absent"), "A"))
    texts = parts.select("p_partkey", F.lit(0).alias("i"), _said(F.col("p_name"), " of ", F.col("p_brand"), " and ", F.col("p_name")).alias("text"))
    found = link.linked_texts(texts, parts.select("p_partkey", F.inline(known)), "p_partkey", "i")
    shown = F.transform(F.array_sort("links", lambda a, b: a["s"] - b["s"]), lambda x: _said(x["path"], "@", x["text"], "@", x["s"].cast("string"), "-", x["e"].cast("string")))
    return found.select("p_partkey", F.array_join(shown, ",").alias("links"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'kb' ELSE 'text' END AS source, 'Q' || p_size AS answer_id, 'Q1,Q' || p_partkey || 'x' AS question_ids, 'What ' || p_type || ' was made by ' || p_name AS main_pseudo_question FROM part WHERE p_partkey % 5 <> 0 AND p_size <> 1""")
def mains_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, even = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    size = _said("Q", F.col("p_size").cast("string"))
    answer = F.struct(size.alias("id"), F.col("p_brand").alias("label"), F.col("p_type").alias("type"), _said("The ", F.col("p_brand")).alias("disam_label"))
    name = F.when(even, F.col("p_brand")).otherwise(_said("The ", F.col("p_brand")))
    rows = table(spark, sf_dir, "part").where("p_size <> 1").select(
        "p_partkey", F.col("p_partkey").alias("evidence_id"), F.when(even, "kb").otherwise("text").alias("source"), _said(name, "  was made by ", F.col("p_name")).alias("candidate_question_text"),
        F.when(F.col("p_partkey") % 5 == 0, F.filter(F.array(answer), lambda x: F.lit(False))).otherwise(F.array(answer)).alias("answers"), F.transform(F.array(F.lit("Q1"), size, _said("Q", key, "x"), F.lit("Q1")), lambda i: F.struct(i.alias("id"))).alias("entities"),
    )
    return questions.main_parts(rows).select(F.col("evidence_id").alias("p_partkey"), "source", "answer_id", F.array_join("question_ids", ",").alias("question_ids"), "main_pseudo_question")


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), m AS (SELECT y, strftime(make_date(2001, unnest(range(1, 13))::INT, 1), '%B') AS name, unnest(range(1, 13)) AS i FROM y)
SELECT y AS year, 'Y' || y AS id, y::VARCHAR AS wiki_path, 'year' AS page_type FROM y
UNION ALL SELECT y, CASE WHEN i <= 4 THEN 'P' ELSE 'M' END || y || '_' || i, CASE WHEN i <= 4 THEN 'Portal:Current_events/' ELSE '' END || name || '_' || y, 'event' FROM m WHERE i <= 8""")
def pages_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    y, i = F.col("year").cast("string"), F.col("i").cast("string")
    months = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i")).withColumn("name", F.date_format(F.make_date(F.lit(2001), "i", F.lit(1)), "MMMM"))
    own = years.select(F.when(F.col("year") % 2 == 0, y).otherwise(_said(F.substring(y, 1, 2), ".", F.substring(y, 3, 2))).alias("path"), _said("Y", y).alias("id"))
    portal = months.where("i <= 4").select(_said("Portal:Current_events/", "", F.col("name"), "_", y).alias("path"), _said("P", y, "_", i).alias("id"))
    # Months 9 and 10 lead to the year's own page, 11 and 12 have none.
    plain = months.where("i <= 10").select(_said(F.col("name"), "_", y).alias("path"), F.when(F.col("i") >= 9, _said("Y", y)).otherwise(_said("M", y, "_", i)).alias("id"))
    return generators.page_pool(years, own.unionByName(portal).unionByName(plain))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)
SELECT p_partkey, array_to_string(t, ' ') AS joined, array_to_string(list_transform(t, lambda x: upper(x[1]) || lower(x[2:])), '|') AS upper_words, len(t) AS n, list_sum(list_transform(t, lambda x: length(x))) AS letters,
  array_to_string(flatten(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i < len(t) THEN [t[i], t[i] || ' ' || t[i + 1]] ELSE [t[i]] END)), '|') AS grams FROM w""")
def tokens_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "part").select("p_partkey", tokens.tokenizer()(F.concat(F.lit(" "), "p_name")).alias("t"))
    t = F.col("t")
    return held.select(
        "p_partkey", tokens.untokenized(t).alias("joined"), F.array_join(F.transform(tokens.told(t, "lemma"), F.initcap), "|").alias("upper_words"), F.size(t).alias("n"),
        F.aggregate(tokens.offsets(t), F.lit(0), lambda a, x: a + x["e"] - x["s"]).alias("letters"), F.array_join(text.ngrams(tokens.token_words(t), 2), "|").alias("grams"),
    )

"""Queries over the star schema, events, embeddings and texts, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, predicates, relations, text
from ..operators import abbreviations, generators, link, questions, records, sample

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks that ``spread`` makes for each core: the longest one is a small part of the whole.
TASKS_A_CORE = 8


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly over several tasks a core where the files have them in fewer partitions; for work that costs far more than the rows. By columns of many values, if there are any, they need not be sorted."""
    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *by) if df.rdd.getNumPartitions() < tasks else df


def day_int(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence: from the order's day to the last shipment's, with customer and least supplier."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.min("l_suppkey").alias("supp"))
    o = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", "o_custkey", "supp", day_int(F.col("o_orderdate")).alias("b"), F.greatest(day_int(F.col("o_orderdate")), day_int(F.col("last"))).alias("e"))


SPANS = """spans AS (
  SELECT o_orderkey, o_custkey, supp, strftime(o_orderdate, '%Y%m%d')::INT AS b, greatest(strftime(o_orderdate, '%Y%m%d')::INT, strftime(last, '%Y%m%d')::INT) AS e
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def sql_signal(b: str, e: str, cs: str, ce: str) -> str:
    jan, dec = (lambda x: f"({x} % 10000 = 101)"), (lambda x: f"({x} % 10000 = 1231)")
    ny = lambda x: f"({x} - {x} % 10000 + 101)"
    equal = f"({b} = {cs} AND {e} = {ce})"
    ce1 = f"(CASE WHEN {jan(cs)} AND {dec(ce)} AND {jan(b)} THEN {ny(ce)} ELSE {ce} END)"
    e1 = f"(CASE WHEN {jan(b)} AND {dec(e)} AND {jan(cs)} THEN {ny(e)} ELSE {e} END)"
    years = f"({jan(b)} AND {dec(e)} AND {jan(cs)} AND {dec(ce)})"
    me, oe = f"(CASE WHEN {years} THEN {ny(e)} ELSE {e} END)", f"(CASE WHEN {years} THEN {ny(ce)} ELSE {ce} END)"
    after = f"NOT {equal} AND (({b} = {e} AND {b} > {ce1} AND {b} - {ce1} < 3) OR ({b} < {e} AND {b} >= {ce1} AND {b} - {ce1} < 3))"
    before = f"NOT {equal} AND (({b} = {e1} AND {e1} < {cs} AND {cs} - {e1} < 3) OR ({b} < {e1} AND {e1} <= {cs} AND {cs} - {e1} < 3) OR ({e1} < {cs} AND {cs} <= {ce} AND {cs} - {e1} < 3))"
    during = f"{equal} OR ({cs} <= {b} AND {oe} >= {me}) OR ({b} <= {cs} AND {me} >= {oe}) OR ({b} <= {cs} AND {me} > {cs} AND {me} <= {oe}) OR ({me} >= {oe} AND {b} > {cs} AND {b} < {oe})"
    return f"CASE WHEN {after} THEN 'AFTER' WHEN {before} THEN 'BEFORE' WHEN {during} THEN 'OVERLAP' END"


@query(f"""WITH {SPANS}, p AS (
  SELECT m.o_orderkey AS main_id, c.o_orderkey AS constraint_id, m.b, m.e, c.b AS cs, c.e AS ce, {sql_signal("m.b", "m.e", "c.b", "c.e")} AS signal
  FROM spans m JOIN spans c ON m.o_custkey = c.o_custkey AND m.o_orderkey <> c.o_orderkey AND m.supp <> c.supp)
SELECT main_id, constraint_id, signal, 'order ' || main_id || ', ' || CASE signal WHEN 'AFTER' THEN 'after' WHEN 'BEFORE' THEN 'before' ELSE 'during' END || ', order ' || constraint_id AS question, b, e, cs, ce
FROM p WHERE signal IS NOT NULL""")
def temporal_signal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_spans(spark, sf_dir)
    c, p, words = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "supp"), F.concat(F.lit("order "), "o_orderkey")
    mains = s.select(F.col("o_orderkey").alias("main_id"), words.alias("text"), F.col("b").alias("begin"), F.col("e").alias("end"), F.array(c).alias("question_ids"), F.array(p).alias("answer_ids"))
    constraints = s.select(F.col("o_orderkey").alias("constraint_id"), words.alias("text"), F.col("b").alias("begin"), F.col("e").alias("end"), F.array(c, p).alias("entity_ids"))
    return questions.temporal_pairs(mains, constraints, suppress_same_fact=False)


@query(f"""WITH {SPANS}, y AS (SELECT o_orderkey, o_custkey, b - b % 10000 + 101 AS b, CASE WHEN o_orderkey % 2 = 0 THEN b - b % 10000 + 1231 ELSE b - b % 10000 + 11231 END AS e FROM spans)
SELECT signal, count(*) AS n, sum(m) AS main_sum FROM (
  SELECT m.o_orderkey AS m, coalesce({sql_signal("m.b", "m.e", "c.b", "c.e")}, 'none') AS signal FROM y m JOIN y c ON m.o_custkey = c.o_custkey AND m.o_orderkey <> c.o_orderkey)
GROUP BY signal""")
def year_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("b") - F.col("b") % 10000
    s = order_spans(spark, sf_dir).select("o_orderkey", "o_custkey", (y + 101).alias("b"), (y + F.when(F.col("o_orderkey") % 2 == 0, 1231).otherwise(11231)).alias("e"))
    s = s.where("b is not null").select("o_orderkey", "o_custkey", relations.span_marks(F.col("b"), F.col("e")).alias("span"))
    pairs = s.alias("m").join(s.alias("c"), "o_custkey").where("m.o_orderkey <> c.o_orderkey")
    found = F.coalesce(relations.marked_signal(F.col("m.span"), F.col("c.span")), F.lit("none"))
    return pairs.select(F.col("m.o_orderkey").alias("m"), found.alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("main_sum"))


# One sentence per grammar; end dates 40 days later. Spark format, SQL expression, expected begin and end in SQL.
_d, _d2 = "day(o_orderdate)", "day(o_orderdate + INTERVAL 40 DAY)"
_m, _m2 = "strftime(o_orderdate, '%B')", "strftime(o_orderdate + INTERVAL 40 DAY, '%B')"
_y, _y2 = "year(o_orderdate)", "year(o_orderdate + INTERVAL 40 DAY)"
_iso, _iso2 = "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d')"
SENTENCES: dict[str, tuple[str, str, str, str]] = {
    "dmy": ("{d} {m} {y}", f"{_d} || ' ' || {_m} || ' ' || {_y}", _iso, _iso),
    "ts1": ("{y}, {m} {d}–{m2} {d2}", f"{_y} || ', ' || {_m} || ' ' || {_d} || '–' || {_m2} || ' ' || {_d2}", _iso, f"{_y} || strftime(o_orderdate + INTERVAL 40 DAY, '-%m-%d')"),
    "ts2": ("{y}–{y3}", f"{_y} || '–' || ({_y} + 3)", f"{_y} || '-01-01'", f"({_y} + 3) || '-12-31'"),
    "ts3": ("{y}, {m} {d}–{e}", f"{_y} || ', ' || {_m} || ' ' || {_d} || '–' || ({_d} + 1)", _iso, f"strftime(o_orderdate, '%Y-%m-') || lpad(({_d} + 1)::VARCHAR, 2, '0')"),
    "ts4": ("{d} {m} {y} – {y3}", f"{_d} || ' ' || {_m} || ' ' || {_y} || ' – ' || ({_y} + 3)", _iso, f"({_y} + 3) || '-12-31'"),
    "ts5": ("{d} {m} {y} – {d2} {m2} {y2}", f"{_d} || ' ' || {_m} || ' ' || {_y} || ' – ' || {_d2} || ' ' || {_m2} || ' ' || {_y2}", _iso, _iso2),
    "ts6": ("{m} {d}, {y} – {m2} {d2}, {y2}", f"{_m} || ' ' || {_d} || ', ' || {_y} || ' – ' || {_m2} || ' ' || {_d2} || ', ' || {_y2}", _iso, _iso2),
    "my": ("{m} {y}", f"{_m} || ' ' || {_y}", "strftime(o_orderdate, '%Y-%m-01')", "strftime(o_orderdate, '%Y-%m-31')"),
    "ymd": ("{y}, {m} {d}", f"{_y} || ', ' || {_m} || ' ' || {_d}", _iso, _iso),
    "mdy": ("{m} {d}, {y}", f"{_m} || ' ' || {_d} || ', ' || {_y}", _iso, _iso),
}


def dated_sentence(form: str) -> Column:
    d = F.col("o_orderdate")
    later = d + F.expr("INTERVAL 40 DAY")
    parts = {"d": F.day(d), "m": F.date_format(d, "MMMM"), "y": F.year(d), "d2": F.day(later), "m2": F.date_format(later, "MMMM"), "y2": F.year(later), "y3": F.year(d) + 3, "e": F.day(d) + 1}
    import re

    pieces = [parts[x[1:-1]].cast("string") if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", form) if x]
    return F.concat(F.lit("An order was placed on "), *pieces, F.lit(" by phone."))


def _grammar_query(grammar: str) -> None:
    form, said, begin, end = SENTENCES[grammar]

    @query(f"SELECT o_orderkey, {said} AS text, {begin} || 'T00:00:00Z' AS begin_ts, {end} || 'T00:00:00Z' AS end_ts FROM orders", name=f"date_parse_{grammar}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", F.explode(dates.grammar_dates(dated_sentence(form), grammar)).alias("x"))
        return o.select("o_orderkey", "x.text", F.col("x.begin").alias("begin_ts"), F.col("x.end").alias("end_ts"))


for _g in SENTENCES:
    _grammar_query(_g)


@query(f"""SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'num_ymd' WHEN 2 THEN CASE WHEN day(o_orderdate) <= 31 THEN 'num_mdy' END ELSE CASE WHEN day(o_orderdate) > 12 THEN 'num_dmy' ELSE 'num_mdy' END END AS method,
  CASE o_orderkey % 4 WHEN 0 THEN {_y} || '-01-01' WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 THEN {_iso} ELSE strftime(o_orderdate, '%Y-%d-%m') END ELSE {_iso} END || 'T00:00:00Z' AS begin_ts,
  CASE o_orderkey % 4 WHEN 0 THEN {_y} || '-12-31' WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 THEN {_iso} ELSE strftime(o_orderdate, '%Y-%d-%m') END ELSE {_iso} END || 'T00:00:00Z' AS end_ts
FROM orders""")
def date_parse_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    token = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", F.concat(F.lit("It was ("), token, F.lit("), they say.")).alias("text"))
    return o.select("o_orderkey", F.explode(dates.numeric_dates(F.regexp_replace("text", r"\),", ")"))).alias("x")).select("o_orderkey", "x.method", F.col("x.begin").alias("begin_ts"), F.col("x.end").alias("end_ts"))


@query(f"""SELECT o_orderkey, {_d} || ' ' || {_m} || ' ' || {_y} || ' – ' || {_d2} || ' ' || {_m2} || ' ' || {_y2} || '=' || {_iso} || '/' || {_iso2}
  || '; ' || {_m} || ' ' || ({_y} + 5) || '=' || ({_y} + 5) || strftime(o_orderdate, '-%m-01') || '/' || ({_y} + 5) || strftime(o_orderdate, '-%m-31')
  || '; ' || ({_y} + 7) || '=' || ({_y} + 7) || '-01-01/' || ({_y} + 7) || '-12-31' AS found
FROM orders""")
def date_overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    said = F.concat(dated_sentence(SENTENCES["ts5"][0]), F.lit(" Again in "), F.date_format(d, "MMMM"), F.lit(" "), (F.year(d) + 5).cast("string"), F.lit(" and "), (F.year(d) + 7).cast("string"), F.lit("."))
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", said.alias("text"))
    shown = F.transform(dates.annotate_dates(F.col("text")), lambda x: F.concat(x["text"], F.lit("="), dates.timestamp_date(x["begin"]), F.lit("/"), dates.timestamp_date(x["end"])))
    return o.select("o_orderkey", F.array_join(shown, "; ").alias("found"))


@query(f"""SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%m-%d') = '01-01' THEN {_y}::VARCHAR ELSE {_d} || ' ' || {_m} || ' ' || {_y} END AS label, strftime(o_orderdate, '%Y%m%d')::INT AS day, strftime(o_orderdate, '%Y') AS year FROM orders""")
def timestamp_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(dates.SUFFIX))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.timestamp_label(ts).alias("label"), dates.timestamp_int(ts).alias("day"), dates.year_of(ts).alias("year"))


@query("""SELECT s::INT AS range_start, least(s + 1, hi)::INT AS range_end, least(s + 1, hi)::INT + 1 AS halo_end, row_number() OVER (ORDER BY s DESC)::INT AS rank
FROM (SELECT max(year(o_orderdate)) AS hi, unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1, 2)) AS s FROM orders)""")
def year_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return generators.year_ranges(spark, lo, hi, 2, halo=1)


@query("""WITH p AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT s, least(s + 1, (SELECT max(y) FROM p)) AS e FROM (SELECT unnest(range(min(y), max(y) + 1, 2)) AS s FROM p))
SELECT s::INT AS range_start, e::INT AS range_end, sum(ceil(n * 1000 / (SELECT sum(n) FROM p)))::BIGINT AS target FROM r JOIN p ON y BETWEEN s AND e GROUP BY s, e""")
def target_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = pages.agg(F.min("year"), F.max("year")).first()
    return generators.apportioned_targets(pages, generators.year_ranges(spark, lo, hi, 2).select("range_start", "range_end"), 1000)


FREQ = "f AS (SELECT l_partkey AS id, count(*) AS frequency FROM lineitem GROUP BY 1), st AS (SELECT *, CASE WHEN frequency < 20 THEN 'long_tail' WHEN frequency > 40 THEN 'prominent' ELSE 'other' END AS stratum FROM f)"


def part_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("frequency"))
    return f.withColumn("stratum", sample.stratum(F.col("frequency"), 20, 40))


@query(f"""WITH {FREQ} SELECT stratum, count(*) AS pool, least(count(*), 50) AS quota FROM st GROUP BY stratum""")
def frequency_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.quotas(part_strata(spark, sf_dir), 150, {"long_tail": 1, "other": 1, "prominent": 1})


def sql_draw(seed: int, *columns: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {" || '|' || ".join(f"{c}::VARCHAR" for c in columns)}), 1, 13))::BIGINT / {16**13}::DOUBLE)"


@query(f"""WITH {FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {sql_draw(3, "id")}, id) AS rn FROM st WHERE id % 7 <> 0)
SELECT id, frequency, stratum FROM r WHERE rn <= 50""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_strata(spark, sf_dir)
    return sample.stratified_sample(s, 150, {"long_tail": 1, "other": 1, "prominent": 1}, 3, taken=s.where("id % 7 = 0")).select("id", "frequency", "stratum")


@query(f"""WITH r AS (SELECT p_partkey, p_type, {sql_draw(0, "p_partkey")} AS u FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY u, p_partkey) AS rn FROM r)
SELECT p_partkey, p_type FROM k WHERE rn <= 11 ORDER BY u, p_partkey LIMIT 100""")
def type_capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.type_capped(table(spark, sf_dir, "part"), 100, key="p_partkey", kind="p_type").select("p_partkey", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def anti_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return records.not_sampled(table(spark, sf_dir, "part"), used, "p_partkey").select("p_partkey", "p_name")


WEIGHTS = "w AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS topics FROM events GROUP BY 1), ww AS (SELECT *, (1 / n::DOUBLE) / sum(1 / n::DOUBLE) OVER () AS weight FROM w)"


@query(f"WITH {WEIGHTS} SELECT event_type, n, topics, round(weight, 9) AS weight FROM ww")
def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.inverse_weights(table(spark, sf_dir, "events"), "event_type", "user_id").withColumn("weight", F.round("weight", 9))


@query(f"""WITH {WEIGHTS}, own AS (SELECT user_id, e.event_type, any_value(weight) AS weight FROM events e JOIN ww ON e.event_type = ww.event_type GROUP BY 1, 2),
c AS (SELECT *, sum(weight) OVER (PARTITION BY user_id ORDER BY event_type) / sum(weight) OVER (PARTITION BY user_id) AS upto, {sql_draw(1, "user_id")} AS u FROM own),
f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN upto > u THEN 0 ELSE 1 END, event_type) AS rn FROM c),
r AS (SELECT e.user_id, e.event_type, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY {sql_draw(2, "e.user_id", "e.event_id")}, e.event_id) AS rn FROM events e JOIN f ON f.rn = 1 AND e.user_id = f.user_id AND e.event_type = f.event_type)
SELECT user_id, event_type, event_id FROM r WHERE rn = 1""")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return sample.weighted_pick(e, sample.inverse_weights(e, "event_type"), "user_id", "event_type", "event_id", 1).select("user_id", "event_type", "event_id")


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT a.label, a.vec_id, b.vec_id AS other, printf('%.3f', {COS}) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE {COS} > CASE WHEN a.vec_id % 3 = 0 OR b.vec_id % 3 = 0 THEN 0.1 ELSE 0.3 END""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("source", F.when(F.col("vec_id") % 3 == 0, "text").otherwise("kb"))
    limit = questions.similar_threshold(F.col("source"), F.col("other_source"), 0.1, 0.3)
    return questions.similar_pairs(v.select("vec_id", "label", "embedding", "source"), "vec_id", "label", "embedding", limit, least=0.1).select("label", "vec_id", "other", F.format_string("%.3f", "score").alias("score"))


SIMQ = """q AS (SELECT o_custkey AS topic, o_orderkey AS question_id, o_orderkey % 50 AS main_id, o_custkey % 3 AS constraint_id, o_orderstatus AS signal FROM orders),
s AS (SELECT a AS main_id, (a + 1) % 50 AS other FROM range(50) t(a)), b AS (SELECT main_id, other FROM s UNION SELECT other, main_id FROM s),
p AS (SELECT x.topic, x.question_id, y.question_id AS other_id FROM q x JOIN q y ON x.topic = y.topic AND x.constraint_id = y.constraint_id AND x.signal = y.signal AND x.question_id < y.question_id JOIN b ON b.main_id = x.main_id AND b.other = y.main_id)"""


def _order_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") % 50).alias("main_id"), (F.col("o_custkey") % 3).alias("constraint_id"), F.col("o_orderstatus").alias("signal"))
    s = spark.range(50).select(F.col("id").alias("main_id"), ((F.col("id") + 1) % 50).alias("other"))
    return q, s


@query(f"WITH {SIMQ} SELECT * FROM p")
def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.similar_questions(*_order_questions(spark, sf_dir))


@query(f"""WITH {SIMQ}, h AS (SELECT p.question_id, string_agg(other_id::VARCHAR || ':' || q.main_id, ',' ORDER BY other_id) AS similar FROM p JOIN q ON q.question_id = p.other_id GROUP BY 1)
SELECT q.question_id, q.topic, q.main_id, h.similar FROM q LEFT JOIN h ON h.question_id = q.question_id""")
def merge_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = _order_questions(spark, sf_dir)
    merged = questions.merge_similar(q, questions.similar_questions(q, s), ["main_id"])
    copies = F.array_join(F.transform("similar", lambda x: F.concat_ws(":", x["id"].cast("string"), x["main_id"].cast("string"))), ",")
    return merged.select("question_id", "topic", "main_id", copies.alias("similar"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events""")
def header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return questions.carried_header(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "user_id", "header")


@query("""WITH u AS (SELECT user_id, event_type, event_id, value, 0 AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, event_id, value, 1 FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC, side DESC) AS rn FROM u) WHERE rn = 1""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return questions.last_per_key(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("""SELECT nationkey, source, count(*) AS n, min(name) AS first_name FROM (
  SELECT c_nationkey AS nationkey, 'customer' AS source, c_name AS name, NULL AS extra FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_name, s_suppkey % 5 FROM supplier)
GROUP BY 1, 2""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("source"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("source"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).alias("extra"))
    return records.union_all(c, s).groupBy("nationkey", "source").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_order FROM orders GROUP BY 1, 2")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_records(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("first_order")), ["o_custkey", "o_orderstatus"], "first_order")


Q_TEXT = """q AS (SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN 'What year was it when ' WHEN 1 THEN 'Which album came out in 1999 after ' WHEN 2 THEN 'How many people saw ' WHEN 3 THEN 'What yearly festival came after '
  WHEN 4 THEN 'When did Ann marry before ' WHEN 5 THEN 'Who (left the band while ' WHEN 6 THEN 'Who sang?? during ' ELSE 'Who met q42 at the time ' END || regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g') AS q, CASE turn % 3 WHEN 0 THEN 'OVERLAP' WHEN 1 THEN 'AFTER' ELSE 'OTHER' END AS signal FROM conversations)"""
ASKS = """(contains(l, 'during what') OR contains(l, 'during which') OR (contains(l, 'what year') AND NOT contains(l, 'what yearly')) OR contains(l, 'which month') OR (contains(l, 'which year') AND NOT contains(l, 'which yearly')) OR contains(l, 'which date') OR contains(l, 'what date') OR contains(l, 'what time')
  OR (list_contains(w, 'when') AND NOT list_has_any(w, ['what', 'which', 'who', 'where'])))"""


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = ["What year was it when ", "Which album came out in 1999 after ", "How many people saw ", "What yearly festival came after ", "When did Ann marry before ", "Who (left the band while ", "Who sang?? during ", "Who met q42 at the time "]
    c = table(spark, sf_dir, "conversations")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " ")
    start = F.get(F.array(*map(F.lit, starts)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    return c.select("conv_id", "turn", F.concat(start, words).alias("q"), F.when(F.col("turn") % 3 == 0, "OVERLAP").when(F.col("turn") % 3 == 1, "AFTER").otherwise("OTHER").alias("signal"))


@query(f"""WITH {Q_TEXT}, x AS (SELECT *, lower(q) AS l, string_split(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), ' ') AS w, regexp_extract_all(lower(q), '([A-Za-z0-9_'']+|[^\\sA-Za-z0-9_''])', 1) AS t FROM q)
SELECT conv_id, turn, CASE WHEN len(w) < 8 THEN 'short' WHEN turn % 13 > 10 THEN 'answers' WHEN len(list_filter(t, lambda z: regexp_full_match(z, '\\d{{4}}'))) > 0 THEN 'year' WHEN len(list_filter(t, lambda z: regexp_full_match(z, 'q\\d+'))) > 0 THEN 'item'
  WHEN contains(l, '??') OR (contains(l, '(') AND NOT contains(l, ')')) THEN 'strange' WHEN conv_id % 13 > 10 THEN 'entities' WHEN contains(l, 'how many') THEN 'number' WHEN {ASKS} THEN 'time' END AS flaw FROM x""")
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posed(spark, sf_dir).select("conv_id", "turn", predicates.question_flaw(F.col("q"), F.col("turn") % 13, F.col("conv_id") % 13).alias("flaw"))


@query(f"""WITH {Q_TEXT}, x AS (SELECT *, lower(q) AS l, string_split(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), ' ') AS w FROM q)
SELECT conv_id, turn, {ASKS} AS asks_time, CASE WHEN signal = 'OVERLAP' THEN NOT regexp_matches(l, 'after|before') WHEN signal = 'AFTER' THEN NOT regexp_matches(l, 'during|while|in the year|when|at the time') END AS kept FROM x""")
def signal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posed(spark, sf_dir).select("conv_id", "turn", predicates.asks_time(F.col("q")).alias("asks_time"), predicates.signal_kept(F.col("q"), F.col("signal")).alias("kept"))


@query(r"""SELECT doc_id, md5(rtrim(regexp_replace(replace(replace(replace(replace(t, '( )', ' '), '( % )', ' '), ', , ', ' '), '•', ' '), '[!-/:-@\[-`{-~]\z', ''), ' ')) AS clean_md5,
  length(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')) AS bare_length, length(regexp_replace(t, ' {2,}', ' ', 'g')) AS squeezed_length,
  CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) END AS n_words
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def noise_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")))
    return d.select("doc_id", F.md5(text.drop_noise(t).cast("binary")).alias("clean_md5"), F.length(text.drop_punctuation(t)).alias("bare_length"), F.length(text.squeeze(t)).alias("squeezed_length"), text.word_count(t).alias("n_words"))


_stop = ", ".join("'" + w.replace("'", "''") + "'" for w in predicates.STOPWORDS)


@query(f"""SELECT doc_id, len(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(replace(text, 'the ', ''), '[!-/:-@\\[-`{{-~]', '', 'g'), ' {{2,}}', ' ', 'g')), '\\s+'), lambda x: x <> '' AND NOT list_contains([{_stop}], x))) = 0 AS empty_relation FROM documents WHERE text IS NOT NULL""")
def no_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", predicates.no_relation(F.col("text"), F.array(F.lit("the "))).alias("empty_relation"))


@query("""SELECT p_partkey, (NOT contains(t, 'USD')) AND (regexp_matches(lower(t), 'social media followers|population|human development index|wikimedia list article|twinned administrative body|gdp per capita|area code|us\\$|ppp per capita') OR (s IN ('info', 'kb') AND list_has_any(string_split(lower(t), ', '), ['hdi', 'gdp']))) AS meaningless
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'kb' WHEN 1 THEN 'info' ELSE 'text' END AS s, p_name || CASE p_partkey % 7 WHEN 0 THEN ', Population' WHEN 1 THEN ', GDP' WHEN 2 THEN ', US$ 4' WHEN 3 THEN ', area code, USD' WHEN 4 THEN ' hdi' ELSE ', 7' END AS t FROM part)""")
def meaningless_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, [", Population", ", GDP", ", US$ 4", ", area code, USD", " hdi", ", 7", ", 7"]))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(F.lit("kb"), F.lit("info"), F.lit("text")), (F.col("p_partkey") % 3).cast("int")).alias("s"), F.concat("p_name", F.get(ends, (F.col("p_partkey") % 7).cast("int"))).alias("t"))
    return p.select("p_partkey", predicates.meaningless_relation(F.col("t"), F.col("s")).alias("meaningless"))


@query("""SELECT o_orderkey, CASE WHEN n = 1 THEN b1 || '/' || e1 WHEN n = 2 THEN least(b1, b2) || '/' || least(e1, e2) END AS span FROM (
  SELECT o_orderkey, strftime(o_orderdate, '%Y-01-01') AS b1, strftime(o_orderdate, '%Y-12-31') AS e1, strftime(o_orderdate + INTERVAL 200 DAY, '%Y-01-01') AS b2, strftime(o_orderdate + INTERVAL 200 DAY, '%Y-12-31') AS e2,
    CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN year(o_orderdate) = year(o_orderdate + INTERVAL 200 DAY) THEN 1 ELSE 2 END AS n FROM orders)""")
def infobox_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    year = lambda n, form: F.date_format(d + F.expr(f"INTERVAL {n} DAY"), form)
    offsets = [0, 200]
    more = lambda form: F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("1000" + form), F.lit("1001" + form), F.lit("1002" + form))).otherwise(F.array())
    begins = F.concat(F.array(*[year(n, "yyyy-01-01") for n in offsets]), more("-01-01").cast("array<string>"))
    ends = F.concat(F.array(*[year(n, "yyyy-12-31") for n in offsets]), more("-12-31").cast("array<string>"))
    span = dates.merged_span(begins, ends)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", span["begin"], span["end"]).alias("span0"), span.isNull().alias("none")).select("o_orderkey", F.when(~F.col("none"), F.col("span0")).alias("span"))


@query("""WITH k AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || '.' WHEN 2 THEN 'Old ' || n_name ELSE 'Nowhere' END AS path, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, path, (SELECT 'Q' || n_nationkey FROM nation n WHERE n.n_name = CASE c_custkey % 4 WHEN 3 THEN '' ELSE k.n_name END) AS id FROM k""")
def coalesce_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    rows = named.select("c_custkey", F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit("."))).when(k == 2, F.concat(F.lit("Old "), "n_name")).otherwise("Nowhere").alias("path"))
    paths = nation.select(F.col("n_name").alias("path"), F.concat(F.lit("Q"), "n_nationkey").alias("id"))
    redirects = nation.select(F.concat(F.lit("Old "), "n_name").alias("from_path"), F.col("n_name").alias("to_title"))
    return link.resolve_paths(rows, paths, redirects)


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q' || s_suppkey ELSE '5 March 2003' END AS label, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE 'NULL' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 7 + s_suppkey ELSE 0 END::BIGINT AS frequency
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    own = F.concat(F.lit("Q"), "s_suppkey")
    s = s.withColumn("id", F.when(k == 3, F.concat(F.lit("2003-03-05"), F.lit(dates.SUFFIX))).otherwise(own)).withColumn("item", own)
    labels = s.where(k < 2).select("id", F.when(k == 0, F.array(own, F.col("s_name"))).otherwise(F.array(F.lit("Q1"), F.lit("Q2"))).alias("labels"))
    entities = s.where("s_suppkey % 3 = 0").select(F.col("item").alias("id"), F.col("n_name").alias("type"), F.array(F.lit(7).cast("bigint"), F.col("s_suppkey")).alias("frequency"))
    return link.with_types(link.with_labels(s.select("s_suppkey", "id", "item"), labels), entities, "item").select("s_suppkey", "label", "type", "frequency")


@query("""SELECT p_partkey, replace(replace(replace(p_name, ' ', '_'), '-', '_'), '''', '%27') AS path, p_name || ' (' || p_brand || ')' AS title FROM part""")
def path_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.concat(F.translate("p_name", " ", "_"), F.lit("_%28"), "p_brand", F.lit("%29"))
    return table(spark, sf_dir, "part").select("p_partkey", text.title_to_path(F.col("p_name")).alias("path"), text.path_to_title(escaped).alias("title"))


@query("""SELECT o_custkey AS topic, bool_or(o_orderstatus <> 'O' AND o_orderkey % 2 = 0) AS kb_centric, bool_or(o_orderstatus = 'O' AND o_orderkey % 2 = 1) AS text_centric FROM orders GROUP BY 1""")
def source_centric(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("kb"), F.lit("info"))).otherwise(F.array(F.lit("info")))
    sources = F.concat(first, F.when(F.col("o_orderstatus") == "O", F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")))
    return questions.source_centric(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), sources.alias("source")))


@query(r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM documents)
SELECT doc_id, count(*) AS n, max(length(sentence)) AS longest FROM s GROUP BY doc_id""")
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = text.page_prose(F.col("text"))
    cut = F.filter(F.transform(F.split(prose, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("i", "sentence"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sentence")).alias("longest"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}(?:[\p{L}.]*\p{L})?\.?')) AS w FROM documents),
c AS (SELECT rtrim(w, '.') AS word, count(*) FILTER (ends_with(w, '.')) AS d, count(*) FILTER (NOT ends_with(w, '.')) AS p FROM w GROUP BY 1),
t AS (SELECT least(sum(d) / sum(d + p), 0.99)::DOUBLE AS r FROM c),
s AS (SELECT word, d, p, length(replace(word, '.', '')) AS l, 2 * (d * ln(0.99::DOUBLE) + p * ln(1 - 0.99::DOUBLE) - d * ln(r) - p * ln(1 - r)) AS ratio FROM c, t WHERE d > 0)
SELECT word, d AS dotted, p AS plain, round(ratio * exp(-l) * (length(word) - l + 1) * pow(l, -p), 4) AS score FROM s WHERE ratio * exp(-l) * (length(word) - l + 1) * pow(l, -p) >= 0.3""")
def abbreviations_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abbreviations.abbreviations(table(spark, sf_dir, "documents")).select("word", "dotted", "plain", F.round("score", 4).alias("score"))


@query("""SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS topics FROM orders GROUP BY 1, 2""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return records.document_frequency(o, ["priority", "status"], "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, s AS source FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'kb' WHEN 1 THEN 'text' WHEN 2 THEN 'info' END AS s FROM lineitem) WHERE s IN ('kb', 'info')""")
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, "kb").when(k == 1, "text").when(k == 2, "info").alias("source"))
    return records.of_sources(rows, ("kb", "info"))


@query("""SELECT l_partkey AS id, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS place FROM lineitem GROUP BY l_partkey""")
def frequency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.by_frequency(table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("frequency")))


@query("""SELECT s_suppkey, 'Q' || s_nationkey AS id, n_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0""")
def id_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("Q"), "n_nationkey").alias("id"), F.col("n_name").alias("path"))
    return records.with_path(table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Q"), "s_nationkey").alias("id")), paths)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '=Q' || p_partkey ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand || '=R' || p_partkey END AS found FROM part""")
def zipped_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    known = F.when(even, F.create_map(F.lit("a"), F.concat(F.lit("Q"), "p_partkey"))).otherwise(F.create_map(F.lit("b"), F.concat(F.lit("R"), "p_partkey")))
    found = records.zipped_ids(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array("p_name", "p_brand"), known)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["text"], x["id"])), ",").alias("found"))


@query("""SELECT y::INT AS year, count(*) AS n, min(name) AS first_name FROM (SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y') || '_' || o_orderkey || '.jsonl' AS name FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY y""")
def files_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.date_format("o_orderdate", "yyyy"))
    found = records.grouped_files(table(spark, sf_dir, "orders").select(F.concat(year, F.lit("_"), "o_orderkey", F.lit(".jsonl")).alias("name")))
    return found.select("year", F.size("names").cast("long").alias("n"), F.get("names", F.lit(0)).alias("first_name"))


@query("""SELECT c_custkey AS topic, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("topic"))
    return records.counts_of_topics(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic")), rows)


@query(f"""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {sql_draw(5, "o_custkey", "o_orderkey")}, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def one_question_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.one_per_entity(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


@query("""WITH s AS (SELECT a.o_orderkey AS main_id, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus)
SELECT o_orderkey AS main_id FROM orders WHERE o_orderkey IN (SELECT main_id FROM s) OR o_orderkey IN (SELECT other FROM s)""")
def mains_with_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    pairs = o.alias("a").join(o.alias("b"), ["o_custkey", "o_orderpriority", "o_orderstatus"]).where("a.o_orderdate < b.o_orderdate").select(F.col("a.o_orderkey").alias("main_id"), F.col("b.o_orderkey").alias("other"))
    return records.with_similar_main(o.select(F.col("o_orderkey").alias("main_id")), pairs)


@query(f"""SELECT o_orderkey, o_orderkey % 7 = 0 AS whole_year, o_orderkey % 3 = 0 AS item, o_orderkey % 3 = 1 AS predicate, o_orderkey % 3 = 2 AS number, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey::VARCHAR WHEN o_orderkey % 3 = 0 THEN 'Q' || o_orderkey ELSE 'P' || o_orderkey END AS value,
  CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS yes FROM orders""")
def value_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Q"), key)).when(k == 1, F.concat(F.lit("P"), key)).otherwise(key)
    url = F.when(k == 0, F.concat(F.lit("http://www.wikidata.org/entity/"), raw)).when(k == 1, F.concat(F.lit("<https://www.wikidata.org/wiki/"), raw, F.lit(">"))).otherwise(F.concat(F.lit('"'), raw, F.lit('"')))
    year = F.year("o_orderdate") * 10000
    end = year + F.when(F.col("o_orderkey") % 7 == 0, 1231).otherwise(1230)
    word = F.when(k == 0, "Yes").when(k == 1, "NO").otherwise("maybe")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", relations.is_whole_year(year + 101, end).alias("whole_year"), text.is_item(raw).alias("item"), text.is_predicate(raw).alias("predicate"), text.is_number(raw).alias("number"), text.wikidata_value(url).alias("value"), text.yes_no(word).alias("yes"))


@query("""SELECT p_partkey, replace(p_name, ' ', 'é"') AS decoded, 'A_' || p_brand AS path, p_name || ', ' || p_brand || ' x, x, ' || p_brand AS title FROM part""")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace("p_name", F.lit(" "), F.lit('\\u00e9"'))
    return table(spark, sf_dir, "part").select("p_partkey", text.unescape(escaped).alias("decoded"), text.local_path(F.concat(F.lit("/wiki/A_"), "p_brand")).alias("path"), link.titled(F.col("p_name"), F.concat(F.col("p_brand"), F.lit(" \t x,\n x, "), F.col("p_brand"))).alias("title"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CASE WHEN l_returnflag = 'N' THEN 'text' ELSE 'kb' END AS s FROM lineitem) WHERE s <> 'text' OR i <= 2""")
def constraint_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", i.alias("i"), F.when(F.col("l_returnflag") == "N", "text").otherwise("kb").alias("s"))
    return rows.where(predicates.constraint_sentence(F.col("i"), F.col("s"), F.lit("entity"), 2)).select("l_orderkey", "l_linenumber")

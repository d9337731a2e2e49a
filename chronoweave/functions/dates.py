"""Dates in text, Column to Column: grammars, numeric forms, overlap resolution, spans and timestamps.

A date is ``struct<text, method, begin, end, s, e>``: timestamps ``YYYY-MM-DDT00:00:00Z`` as strings, since
days need not exist (months end on day 31), and the half-open place in the text, by code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = "T00:00:00Z"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DATE = "struct<text:string,method:string,begin:string,end:string,s:int,e:int>"
_W = r"[A-z]*"
_full = "|".join([m.capitalize() for m in MONTHS] + MONTHS)
# The grammars of dates in text.
#: Grammar, and its groups: which hold year, month, day of the beginning and of the end.
GRAMMARS: dict[str, tuple[str, tuple[int, int, int], tuple[int, int, int]]] = {
    "dmy": (rf"(\d+) ({_W}) (\d\d\d\d)", (3, 2, 1), (3, 2, 1)),
    "ts1": (r"(?U)(\d{4}),\s(\w+)\s(\d{1,2})–(\w+)\s(\d{1,2})", (1, 2, 3), (1, 4, 5)),
    "ts2": (r"(\d{4})–(\d{4})", (1, 0, 0), (2, 0, 0)),
    "ts3": (r"(?U)(\d{4}),\s(\w+)\s(\d{1,2})–(\d{1,2})", (1, 2, 3), (1, 2, 4)),
    "ts4": (r"(?U)(\d{1,2})\s(\w+)\s(\d{4})\s–\s(\d{4})", (3, 2, 1), (4, 0, 0)),
    "ts5": (r"(?U)(\d{1,2})\s(\w+)\s(\d{4})\s–\s(\d{1,2})\s(\w+)\s(\d{4})", (3, 2, 1), (6, 5, 4)),
    "ts6": (r"(?U)(\w+)\s(\d{1,2}),\s(\d{4})\s–\s(\w+)\s(\d{1,2}),\s(\d{4})", (3, 1, 2), (6, 4, 5)),
    "my": (rf"(?U)\b({_full})\s(\d{{4}})\b", (2, 1, 0), (2, 1, 0)),
    "ymd": (rf"(\d\d\d\d), ({_W}) (\d+)", (1, 2, 3), (1, 2, 3)),
    "mdy": (rf"({_W}) (\d+), (\d\d\d\d)", (3, 1, 2), (3, 1, 2)),
}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def month_number(name: Column) -> Column:
    """Two digits of a long or three-letter English month name in any case, else null."""
    names = {k: f"{i:02d}" for i, m in enumerate(MONTHS, 1) for k in (m, m[:3])}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(name))


def month_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m.capitalize()) for m in MONTHS]), number.cast("int") - 1)


def timestamp(y: Column, m: Column, d: Column) -> Column:
    """A day of one digit gets a zero; longer ones stay as written, and are no day that the bounds let through."""
    return F.concat(y, F.lit("-"), m, F.lit("-"), F.when(F.length(d) < 2, F.lpad(d, 2, "0")).otherwise(d), F.lit(SUFFIX))


def year_span(y: Column) -> tuple[Column, Column]:
    return timestamp(y, F.lit("01"), F.lit("01")), timestamp(y, F.lit("12"), F.lit("31"))


def month_span(y: Column, m: Column) -> tuple[Column, Column]:
    """A month ends on day 31, whichever it is."""
    return timestamp(y, m, F.lit("01")), timestamp(y, m, F.lit("31"))


def _side(found: Column, pattern: str, groups: tuple[int, int, int], last: bool) -> Column:
    y, m, d = (F.regexp_extract(found, pattern, g) if g else None for g in groups)
    if m is None:
        return year_span(y)[last]
    month = month_number(m)
    if d is None:
        return month_span(y, month)[last]
    return timestamp(y, month, d)


def grammar_dates(text: Column, grammar: str) -> Column:
    """Dates of one grammar; a match whose month is no month is none. Each is placed where its text first occurs."""
    pattern, first, last = GRAMMARS[grammar]
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    dated = F.transform(
        found,
        lambda x: F.struct(
            x.alias("text"), F.lit(grammar).alias("method"), _side(x, pattern, first, False).alias("begin"), _side(x, pattern, last, True).alias("end"),
            (F.position(x, text) - 1).alias("s"), (F.position(x, text) - 1 + F.length(x)).alias("e"),
        ),
    )
    return F.filter(dated, lambda x: x["begin"].isNotNull() & x["end"].isNotNull())


def text_dates(text: Column) -> Column:
    """Dates of all grammars, in the grammars' order."""
    return F.concat(*[grammar_dates(text, g) for g in GRAMMARS])


def numeric_span(token: Column) -> Column:
    """``struct<method, begin, end>`` of a bare token: a year, year-month-day, month-day-year or else day-month-year; null for others.

    Month 0 is the whole year and day 0 the whole month.
    """
    ymd, dmy = r"^(\d{4})[-|/.](\d{1,2})[-|/.](\d{1,2})$", r"^(\d{1,2})[-|/.](\d{1,2})[-|/.](\d{4})$"

    def normal(y: Column, m: Column, d: Column, name: str) -> Column:
        mi, di = m.try_cast("int"), d.try_cast("int")
        yb, ye = year_span(y)
        mb, me = month_span(y, F.lpad(m, 2, "0"))
        day = timestamp(y, F.lpad(m, 2, "0"), d)
        out = lambda b, e: F.struct(F.lit(name).alias("method"), b.alias("begin"), e.alias("end"))
        return F.when(mi == 0, out(yb, ye)).when(mi.between(1, 12) & (di == 0), out(mb, me)).when(mi.between(1, 12) & di.between(1, 31), out(day, day))

    g = lambda p, i: F.regexp_extract(token, p, i)
    yb, ye = year_span(token)
    return (
        F.when(token.rlike(r"^\d{4}$"), F.struct(F.lit("year").alias("method"), yb.alias("begin"), ye.alias("end")))
        .when(token.rlike(ymd), normal(g(ymd, 1), g(ymd, 2), g(ymd, 3), "num_ymd"))
        .when(token.rlike(dmy), F.coalesce(normal(g(dmy, 3), g(dmy, 1), g(dmy, 2), "num_mdy"), normal(g(dmy, 3), g(dmy, 2), g(dmy, 1), "num_dmy")))
    )


def numeric_dates(text: Column) -> Column:
    """Dates of the tokens that single spaces part, punctuation stripped; both forms of day and month are read from the stripped token."""
    from .text import strip_token

    tokens = F.array_distinct(F.transform(F.filter(F.split(text, " "), lambda t: t.rlike("[0-9]")), strip_token))
    spans = F.filter(F.transform(tokens, lambda t: F.struct(t.alias("t"), numeric_span(t).alias("n"))), lambda x: x["n"].isNotNull())
    return F.transform(
        spans,
        lambda x: F.struct(x["t"].alias("text"), x["n"]["method"].alias("method"), x["n"]["begin"].alias("begin"), x["n"]["end"].alias("end"), (F.position(x["t"], text) - 1).alias("s"), (F.position(x["t"], text) - 1 + F.length(x["t"])).alias("e")),
    )


def resolve_overlaps(dates: Column) -> Column:
    """Of dates with one span the last, at the first's place; then those no longer, or equally long and later, date overlaps.

    Spans that touch overlap. A date that loses still beats those it is longer than.
    """
    same = lambda x, y: (x["s"] == y["s"]) & (x["e"] == y["e"])
    beats = lambda y, x: (y["v"]["e"] >= x["v"]["s"]) & (y["v"]["s"] <= x["v"]["e"]) & ((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["p"] > x["p"])))

    def once(d: Column) -> Column:
        firsts = F.filter(d, lambda x, i: F.forall(F.slice(d, F.lit(1), i), lambda y: ~same(x, y)))
        last = F.transform(firsts, lambda x: F.element_at(F.filter(d, lambda y: same(x, y)), -1))
        return F.transform(last, lambda x, i: F.struct(x.alias("v"), i.alias("p"), (x["e"] - x["s"]).alias("n")))

    def kept(placed: Column) -> Column:
        return F.transform(F.filter(placed, lambda x: ~F.exists(placed, lambda y: beats(y, x))), lambda x: x["v"])

    return let(dates, lambda d: let(once(d), kept))


def annotate_dates(text: Column) -> Column:
    """All dates of a text: grammars, then numbers, then overlaps resolved, by place. One Arrow pass."""
    from .date_scan import scan_texts

    return F.arrow_udf(scan_texts, f"array<{DATE}>")(text)


def annotate_dates_native(text: Column) -> Column:
    """``annotate_dates`` by built-in functions alone, for places that take no Python function; some tens of times slower."""
    return F.array_sort(resolve_overlaps(F.concat(text_dates(text), numeric_dates(text))), lambda a, b: a["s"] - b["s"])


def is_timestamp(c: Column) -> Column:
    return F.coalesce(c.rlike(r'^"?-?\d{4}-\d\d-\d\dT00:00:00Z'), F.lit(False))


def is_year(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}$"), F.lit(False))


def year_of(ts: Column) -> Column:
    return F.regexp_extract(ts, r"^\"?(-?\d{4})-", 1)


def timestamp_label(ts: Column) -> Column:
    """``5 March 2003``; the bare year for 1 January; other texts as they are."""
    y, m, d = (F.regexp_extract(ts, r'^"?(\d{4})-(\d\d)-(\d\d)T', i) for i in (1, 2, 3))
    name = month_name(m.try_cast("int"))
    return F.when(~is_timestamp(ts) | name.isNull(), ts).when((m == "01") & (d == "01"), y).otherwise(F.concat_ws(" ", F.ltrim(d, F.lit("0")), name, y))


def timestamp_date(ts: Column) -> Column:
    return F.replace(ts, F.lit(SUFFIX), F.lit(""))


def timestamp_int(ts: Column) -> Column:
    """``yyyymmdd``, null if it is no timestamp."""
    return F.replace(F.replace(ts, F.lit(SUFFIX), F.lit("")), F.lit("-"), F.lit("")).try_cast("int")


def merged_span(begins: Column, ends: Column) -> Column:
    """One distinct span as it is; of two the least beginning and the least end; null for others."""
    spans = F.array_distinct(F.arrays_zip(begins.alias("begin"), ends.alias("end")))
    return F.when(F.size(spans) == 1, F.get(spans, F.lit(0))).when(F.size(spans) == 2, F.struct(F.array_min(F.transform(spans, lambda x: x["begin"])).alias("begin"), F.array_min(F.transform(spans, lambda x: x["end"])).alias("end")))


def widened_end(end: Column, open_end: str | None = None) -> Column:
    """A fact's end: 1 January stands for its year and becomes 31 December; a missing one is ``open_end``."""
    wide = F.when(end.rlike(r"-01-01T00:00:00Z$"), F.regexp_replace(end, "-01-01T", "-12-31T")).otherwise(end)
    return F.coalesce(wide, F.lit(open_end)) if open_end else wide


def remove_spans(text: Column, spans: Column) -> Column:
    """A text without the places ``array<struct<s, e>>``, from the last on."""
    ordered = F.array_sort(spans, lambda a, b: b["e"] - a["e"])
    return F.aggregate(ordered, text, lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["s"]), F.substring(acc, x["e"] + 1, F.length(acc))))

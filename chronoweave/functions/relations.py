"""Before, after and during on closed spans of ``yyyymmdd`` integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest difference of neighbours: of the integers themselves, or of the years.
GAP = 3


def _jan1(x: Column) -> Column:
    return x % 10000 == 101


def _dec31(x: Column) -> Column:
    return x % 10000 == 1231


def _new_year(x: Column) -> Column:
    return x - x % 10000 + 101


def _near(later: Column, earlier: Column, gap_mode: str) -> Column:
    """Neighbours: the integers differ by less than GAP, so days of one month only; ``years`` compares years instead."""
    if gap_mode == "int":
        return later - earlier < GAP
    return F.floor(later / 10000) - F.floor(earlier / 10000) < GAP


def span_marks(b: Column, e: Column) -> Column:
    """What the relations need of a span, worked out once for each span and not for each pair: its ends, whether it begins on 1 January and ends on 31 December, and the new year of its end's year.

    For spans without nulls.
    """
    # No field is ever null: tests for nulls would make the pairs' code too long for the JVM to compile.
    some = lambda x: F.coalesce(x, F.lit(0))
    no = F.lit(False)
    return F.struct(some(b).alias("b"), some(e).alias("e"), F.coalesce(_jan1(b), no).alias("j"), F.coalesce(_dec31(e), no).alias("d"), some(_new_year(e)).alias("y"))


def _end(x: Column, other: Column) -> Column:
    """Where a span ends beside another: whole years end where they begin if the other begins on 1 January."""
    return F.when(x["j"] & x["d"] & other["j"], x["y"]).otherwise(x["e"])


def _same(m: Column, c: Column) -> Column:
    return (m["b"] == c["b"]) & (m["e"] == c["e"])


def _after(m: Column, c: Column, end: Column, gap_mode: str) -> Column:
    follows = F.when(m["b"] == m["e"], m["b"] > end).otherwise((m["b"] < m["e"]) & (m["b"] >= end))
    return ~_same(m, c) & _near(m["b"], end, gap_mode) & follows


def _before(m: Column, c: Column, end: Column, gap_mode: str) -> Column:
    precedes = F.when(m["b"] <= end, end < c["b"]).otherwise(False) | ((m["b"] < end) & (end <= c["b"])) | ((end < c["b"]) & (c["b"] <= c["e"]))
    return ~_same(m, c) & _near(c["b"], end, gap_mode) & precedes


def _during(m: Column, c: Column) -> Column:
    years = m["j"] & m["d"] & c["j"] & c["d"]
    me, oe = F.when(years, m["y"]).otherwise(m["e"]), F.when(years, c["y"]).otherwise(c["e"])
    inside, around = (c["b"] <= m["b"]) & (oe >= me), (m["b"] <= c["b"]) & (me >= oe)
    head, tail = (m["b"] <= c["b"]) & (me > c["b"]) & (me <= oe), (me >= oe) & (m["b"] > c["b"]) & (m["b"] < oe)
    return _same(m, c) | inside | around | head | tail


def is_after(b: Column, e: Column, cs: Column, ce: Column, gap_mode: str = "int") -> Column:
    """The main span (b, e) begins at or soon after the end of (cs, ce); whole years end where they begin."""
    m, c = span_marks(b, e), span_marks(cs, ce)
    return _after(m, c, _end(c, m), gap_mode)


def is_before(b: Column, e: Column, cs: Column, ce: Column, gap_mode: str = "int") -> Column:
    m, c = span_marks(b, e), span_marks(cs, ce)
    return _before(m, c, _end(m, c), gap_mode)


def is_during(b: Column, e: Column, cs: Column, ce: Column) -> Column:
    return _during(span_marks(b, e), span_marks(cs, ce))


def marked_signal(m: Column, c: Column, gap_mode: str = "int") -> Column:
    """``signal`` of two spans whose ``span_marks`` are known."""
    return F.when(_after(m, c, _end(c, m), gap_mode), "AFTER").when(_before(m, c, _end(m, c), gap_mode), "BEFORE").when(_during(m, c), "OVERLAP")


def signal(b: Column, e: Column, cs: Column, ce: Column, gap_mode: str = "int") -> Column:
    """AFTER, else BEFORE, else OVERLAP, else null."""
    return F.when(b.isNotNull() & e.isNotNull() & cs.isNotNull() & ce.isNotNull(), marked_signal(span_marks(b, e), span_marks(cs, ce), gap_mode))


def signal_word(s: Column) -> Column:
    return F.when(s == "AFTER", "after").when(s == "BEFORE", "before").when(s == "OVERLAP", "during")


def is_whole_year(b: Column, e: Column) -> Column:
    return _jan1(b) & _dec31(e) & (F.floor(b / 10000) == F.floor(e / 10000))

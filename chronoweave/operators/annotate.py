"""The full annotator: dates, ordinals and explicit expressions of a text, numbered, with links to the dates they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import annotate_dates, let
from .ordinals import annotate_ordinals
from .signals import explicit_expressions


def annotations(text: Column, dates: Column | None = None) -> Column:
    """``array<struct<id, type, mention, method, signal, begin, end, ordinal, s, e, nest>>``: dates first, then ordinals that no date
    holds, then explicit expressions, each by place; ids run from 0, ``nest`` are the ids of an expression's dates. Null texts give null.
    """
    if dates is None:
        return let(annotate_dates(text), lambda d: annotations(text, d))
    found = F.struct(dates.alias("d"), annotate_ordinals(text, dates).alias("o"), explicit_expressions(text, dates).alias("x"))
    return let(found, lambda f: _numbered(f["d"], f["o"], f["x"]))


def _numbered(dates: Column, ordinals: Column, expressions: Column) -> Column:
    none, no_dates = F.lit(None), F.array().cast("array<int>")

    def row(x: Column, i: Column, kind: str, method: Column, signal: Column, begin: Column, end: Column, ordinal: Column, nest: Column) -> Column:
        return F.struct(
            i.cast("int").alias("id"), F.lit(kind).alias("type"), x["text"].alias("mention"), method.alias("method"), signal.alias("signal"), begin.cast("string").alias("begin"), end.cast("string").alias("end"),
            ordinal.cast("int").alias("ordinal"), x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"), nest.alias("nest"),
        )

    def held(x: Column) -> Column:
        ids = F.transform(dates, lambda d, i: F.when((d["s"] >= x["s"]) & (d["e"] <= x["e"]), i))
        return F.filter(ids, lambda i: i.isNotNull())

    n, m = F.size(dates), F.size(ordinals)
    return F.concat(
        F.transform(dates, lambda x, i: row(x, i, "date", x["method"], F.lit(""), x["begin"], x["end"], none, no_dates)),
        F.transform(ordinals, lambda x, i: row(x, i + n, "ordinal", F.lit("regex"), F.lit("ORDINAL"), none, none, x["ordinal"], no_dates)),
        F.transform(expressions, lambda x, i: row(x, i + n + m, "explicit", F.lit("pattern"), x["signal"], x["begin"], x["end"], none, held(x))),
    )

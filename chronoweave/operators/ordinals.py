"""Ordinals in text: words, digits, compounds, latest and oldest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, let

# Ordinal words by number; 14 and 17 stand there as cardinals.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteen", "fifteenth", "sixteenth", "seventeen", "eighteenth", "nineteenth", "twentieth"]
LATEST, OLDEST = ["latest", "newest", "last"], ["oldest"]
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_SUPERLATIVES = r"^(?:[a-z]{2,}est|most|least|best|worst)$"
_TOKEN = r"([A-Za-z0-9]+|[^\sA-Za-z0-9])"


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def annotate_ordinals(text: Column, dates: Column | None = None) -> Column:
    """``array<struct<text, ordinal, s, e>>`` by place: -1 is the latest, 0 the oldest.

    An ordinal next to a month or before a superlative is none (superlatives by a rule), nor is one that
    lies in one of ``dates``. "most recent" and "most recently" are the latest, but not at the end of the text.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(_TOKEN), 1).alias("tokens"), F.split(text, _TOKEN, -1).alias("gaps"))
    every = let(parts, lambda p: F.transform(_ordinals(p["tokens"]), lambda x: _placed(p["tokens"], p["gaps"], x)))
    if dates is None:
        return every
    return F.filter(every, lambda x: ~F.exists(dates, lambda d: (d["s"] <= x["s"]) & (x["e"] <= d["e"])))


def _placed(tokens: Column, gaps: Column, x: Column) -> Column:
    """An ordinal of tokens ``first`` to ``last`` with its place: the length of the tokens and gaps before."""

    def start(i: Column) -> Column:
        return F.length(F.array_join(F.slice(tokens, F.lit(1), i), "")) + F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), ""))

    return F.struct(x["text"].alias("text"), x["ordinal"].alias("ordinal"), start(x["first"]).alias("s"), (start(x["last"]) + F.length(F.get(tokens, x["last"]))).alias("e"))


def _ordinals(tokens: Column) -> Column:
    low = F.transform(tokens, F.lower)
    numbers = {w: i for i, w in enumerate(ORDINALS, 1)}
    months = F.array(*[F.lit(x) for m in MONTHS for x in {m, m[:3]}])
    n = F.size(tokens)

    def at(i: Column, step: int) -> Column:
        return F.get(low, i + step)

    def found(w: Column, i: Column) -> Column:
        value = F.coalesce(_lookup(numbers, w), F.when(w.rlike(r"^[0-9]+[stndrh|]{2}$"), F.regexp_extract(w, r"^(\d+)", 1).try_cast("int")))
        clash = F.when(i > 0, F.array_contains(months, at(i, -1))).otherwise(False) | F.when(i < n - 1, F.coalesce(F.array_contains(months, at(i, 1)) | at(i, 1).rlike(_SUPERLATIVES), F.lit(False))).otherwise(False)
        part = F.coalesce((at(i, -1) == "-") & _lookup(TENS, at(i, -2)).isNotNull(), F.lit(False))
        plain = F.when(value.isNotNull() & ~F.coalesce(clash, F.lit(False)) & ~part, value)
        compound = F.when(F.coalesce(at(i, 1) == "-", F.lit(False)), _lookup(TENS, w) + _lookup(numbers, at(i, 2)))
        recent = (w == "most") & at(i, 1).isin("recent", "recently") & (i + 2 < n)
        ordinal = F.when(compound.isNotNull(), compound).when(w.isin(*LATEST), -1).when(w.isin(*OLDEST), 0).when(F.coalesce(recent, F.lit(False)), -1).otherwise(plain)
        label = F.when(compound.isNotNull(), F.concat(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))).when(F.coalesce(recent, F.lit(False)), F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1))).otherwise(F.get(tokens, i))
        last = i + F.when(compound.isNotNull(), 2).when(F.coalesce(recent, F.lit(False)), 1).otherwise(0)
        return F.struct(label.alias("text"), ordinal.cast("int").alias("ordinal"), i.alias("first"), last.alias("last"))

    return F.filter(F.transform(low, found), lambda x: x["ordinal"].isNotNull())

"""Signals: keywords before dates, and spans between two dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import annotate_dates, let
from ..functions.lemmas import DETERMINERS, INVARIANT, forms, lemma

# Keywords of each signal. A keyword may serve two.
KEYWORDS: dict[str, list[str]] = {
    "BEFORE": ["before", "prior", "prior to", "precede by", "no later than"],
    "AFTER": ["follow by", "after", "later than"],
    "OVERLAP": ["in", "within", "on", "during", "while", "when", "point in time is", "at the time of", "time point is", "as of", "as", "in the year", "on the date of"],
    "START": ["from", "since", "start", "start time", "start time is", "at the beginning of", "in the beginning of", "start in", "begin time", "begin on", "begin", "begin in", "open", "at the start of"],
    "FINISH": ["until", "till", "end time is", "at the end of", "conclusion time is", "finished on", "by", "end", "closure", "end time", "ending in"],
    "DURATION": ["to", "till", "until", "and"],
}
def keyword_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(signal, keywords)`` from a ``keyword||SIGNAL`` file, or the library's own."""
    if path is None:
        rows = [(k, s) for s, ks in KEYWORDS.items() for k in ks]
        pairs = spark.createDataFrame(rows, "keyword string, signal string")
    else:
        parts = F.split("value", r"\|\|")
        pairs = spark.read.text(path).where(F.contains("value", F.lit("||"))).select(F.trim(parts[0]).alias("keyword"), F.trim(parts[1]).alias("signal"))
    return pairs.groupBy("signal").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def read_keywords(spark: SparkSession, path: str | None = None) -> dict[str, list[str]]:
    """``keyword_table`` as what ``explicit_expressions`` takes; a keyword list is some dozens of rows by nature."""
    return {r["signal"]: r["keywords"] for r in keyword_table(spark, path).orderBy("signal").collect()}


def lemmas_of(keywords: dict[str, list[str]]) -> frozenset[str]:
    """The words of keywords: the lemmas that a lemmatiser for them has to know."""
    return frozenset(w for ks in keywords.values() for k in ks for w in k.split())


def unreachable(keywords: dict[str, list[str]]) -> set[str]:
    """Keywords that no text has: one of their words is no lemma but an inflected form ("is", "finished")."""
    known = lemmas_of(keywords)
    own = lambda w, before: lemma(w, before, known) == w or lemma(w, DETERMINERS[0], known) == w and before in ("", *DETERMINERS)
    return {k for ks in keywords.values() for k in ks if not all(own(w, before) for w, before in zip(k.split(), ["", *k.split()]))}


def _alternatives(signal: str, keywords: dict[str, list[str]]) -> str:
    """A pattern of all forms of a signal's keywords. Keywords that end in another one of the signal are left out: the shorter one wins."""
    known, never = lemmas_of(keywords), unreachable(keywords)
    noun = rf"(?<=\b(?:{'|'.join(DETERMINERS)})\s{{1,9}})"

    def word(w: str, before: str) -> str:
        """``w`` as any of its forms; in -ing they are verbs, so that no determiner precedes, and nouns are their own lemma behind one."""
        found = [f if not f.endswith("ing") or f in INVARIANT else "" if before in DETERMINERS else noun.replace("?<=", "?<!") + f for f in forms(w, known)]
        found += [w if before in DETERMINERS else noun + w] if w.endswith("ing") and w not in INVARIANT else []
        return f"(?:{'|'.join(f for f in found if f)})"

    own = [k for k in keywords.get(signal, []) if k not in never]
    least = [k for k in own if not any(k.endswith(f" {x}") for x in own)]
    return "|".join(r"\s+".join(word(w, before) for w, before in zip(k.split(), ["", *k.split()])) for k in sorted(least, key=len, reverse=True)) or "(?!)"


def explicit_expressions(text: Column, dates: Column | None = None, keywords: dict[str, list[str]] | None = None, tokens: Column | None = None) -> Column:
    """One expression per date: ``array<struct<text, signal, signal_text, begin, end, s, e>>``.

    A date that a DURATION holds gives the DURATION from the least beginning to the greatest end; others
    take the shortest keyword before them (ties: the signal that ``keywords`` names first), and "No signal" without one.
    Keywords are lemmas. With ``tokens`` of any tokenizer their lemmas are read; without, all forms that affix rules
    give a keyword's words are looked for by built-in functions. Null texts give null.
    """
    keywords = keywords or KEYWORDS
    if dates is None:
        return let(annotate_dates(text), lambda d: explicit_expressions(text, d, keywords, tokens))
    gap = lambda a, z: F.substring(text, a["e"] + 1, z["s"] - a["e"])
    if tokens is None:
        before = lambda d: F.substring(text, F.lit(1), d["s"])
        link = rf"(?i)^\s+(?:{_alternatives('DURATION', keywords)})\s+$"
        linked = lambda a, z: gap(a, z).rlike(link)
        patterns = {s: rf"(?i)(?:^|[^\w])((?:{_alternatives(s, keywords)})\s+)$" for s in keywords if s != "DURATION"}

        def single(d: Column) -> Column:
            found = {s: F.regexp_extract(before(d), p, 1) for s, p in patterns.items()}
            options = F.array(*[F.struct(F.length(raw).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("signal"), raw.alias("raw")) for i, (s, raw) in enumerate(found.items())])
            return F.array_min(F.filter(options, lambda o: o["n"] > 0))
    else:
        signals = {k: s for s in reversed(list(keywords)) if s != "DURATION" for k in keywords[s]}
        most = max(len(k.split()) for k in signals)
        told = F.create_map(*[F.lit(x) for pair in signals.items() for x in pair])
        said = lambda t: F.array_join(F.transform(t, lambda x: x["lemma"]), " ")
        spaced = lambda c: c.rlike(r"^\s") & c.rlike(r"\s$")
        linked = lambda a, z: spaced(gap(a, z)) & said(F.filter(tokens, lambda t: (t["s"] >= a["e"]) & (t["e"] <= z["s"]))).isin(keywords.get("DURATION", []))

        def single(d: Column) -> Column:
            return let(F.filter(tokens, lambda t: t["e"] <= d["s"]), lambda left: shortest(d, left))

        def shortest(d: Column, left: Column) -> Column:
            """The trie of keywords read backwards from the date: the first node that ends a keyword."""
            ends = [let(F.slice(left, -n, n), lambda own: F.struct(F.try_element_at(told, said(own)).alias("signal"), F.substring(text, own[0]["s"] + 1, d["s"] - own[0]["s"]).alias("raw"))) for n in range(1, most + 1)]
            hits = [F.when((F.size(left) >= n) & x["signal"].isNotNull() & x["raw"].rlike(r"\s$"), x) for n, x in enumerate(ends, 1)]
            return F.coalesce(*hits)

    def partner(d: Column) -> Column:
        def apart(o: Column) -> Column:
            a, z = F.when(o["e"] < d["s"], o).otherwise(d), F.when(o["e"] < d["s"], d).otherwise(o)
            return (a["e"] < z["s"]) & linked(a, z)

        return F.filter(dates, apart)

    def expression(d: Column) -> Column:
        found = F.struct(F.try_element_at(partner(d), F.lit(-1)).alias("o"), single(d).alias("one"))
        return let(found, lambda f: whole(d, f["o"], f["one"]))

    def whole(d: Column, o: Column, one: Column) -> Column:
        pair = o.isNotNull()
        s = F.when(pair, F.least(d["s"], o["s"])).otherwise(d["s"] - F.coalesce(F.length(one["raw"]), F.lit(0)))
        e = F.when(pair, F.greatest(d["e"], o["e"])).otherwise(d["e"])
        return F.struct(
            F.substring(text, s + 1, e - s).alias("text"), F.when(pair, "DURATION").otherwise(F.coalesce(one["signal"], F.lit("No signal"))).alias("signal"), F.when(~pair, F.rtrim(one["raw"])).alias("signal_text"),
            F.when(pair, F.least(d["begin"], o["begin"])).otherwise(d["begin"]).alias("begin"), F.when(pair, F.greatest(d["end"], o["end"])).otherwise(d["end"]).alias("end"), s.cast("int").alias("s"), e.cast("int").alias("e"),
        )

    return F.array_distinct(F.transform(dates, expression))

"""Filters on evidence and questions, Column to Column."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PUNCTUATION, words

# Phrases and items of facts without meaning for questions.
MEANINGLESS = ["social media followers", "population", "human development index", "wikimedia list article", "twinned administrative body", "gdp per capita", "area code", "us$", "ppp per capita"]
MEANINGLESS_ITEMS = ["hdi", "gdp"]
# Signals that spoil a snippet.
SPOILING_SIGNALS = ["BEFORE", "AFTER", "START", "FINISH"]
NO_TYPES = ["NULL", "Wikimedia list article"]
# Common English words without a relation of their own.
STOPWORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was
were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
_death = {"die", "dies", "died", "dying", "death", "deaths", "dead"}
_birth = {"bear", "bears", "bore", "born", "bearing", "birth", "births"}
_spouse = {"spouse", "spouses"}


def _any(text: Column, parts: Collection[str]) -> Column:
    """Whether ``text`` contains one of ``parts``: far cheaper than taking it to words, which only those texts need that do."""
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def meaningless_relation(text: Column, source: Column) -> Column:
    """A blacklisted phrase or, in facts and tables, item. Amounts in USD are exempt."""
    low = F.lower(text)
    phrase = _any(low, MEANINGLESS)
    held = _any(low, MEANINGLESS_ITEMS)
    item = source.isin("info", "kb") & F.when(held, F.arrays_overlap(F.split(low, ", "), F.array(*map(F.lit, MEANINGLESS_ITEMS)))).otherwise(held)
    return ~F.contains(text, F.lit("USD")) & (phrase | item)


def no_relation(template: Column, mentions: Column) -> Column:
    """Nothing but stopwords once mentions and punctuation are gone."""
    left = F.aggregate(mentions, template, lambda acc, m: F.when(m == "", acc).otherwise(F.replace(acc, m, F.lit(""))))
    return F.size(F.filter(F.split(F.lower(F.translate(left, PUNCTUATION, "")), r"\s+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))) == 0


def spoiled(signals: Column) -> Column:
    return F.exists(signals, lambda s: s.isin(*SPOILING_SIGNALS))


def snippet_kept(source: Column, spans: Column, signals: Column) -> Column:
    """Snippets of entity pages: texts with one span and no spoiling signal, tables with one or two spans."""
    n = F.size(F.array_distinct(spans))
    return F.when(source == "text", (n == 1) & ~spoiled(signals)).when(source == "info", n.between(1, 2)).otherwise(False)


def year_snippet_kept(spans: Column, signals: Column) -> Column:
    return (F.size(F.array_distinct(spans)) == 1) & ~spoiled(signals)


def non_date_entities(entities: Column) -> Column:
    """Entities whose type names no time; an unknown type counts as NULL and stays."""
    return F.filter(entities, lambda x: ~F.lower(F.coalesce(x["type"], F.lit("NULL"))).rlike("calendar|year|time|day"))


def answerable(entities: Column, topic: Column) -> Column:
    return F.filter(entities, lambda x: (x["id"] != topic) & ~F.coalesce(x["type"], F.lit("NULL")).isin(*NO_TYPES))


def constraint_sentence(index: Column, source: Column, page: Column, last: int = 10) -> Column:
    """Of entity pages' texts the sentences 0 to ``last``; all else is unrestricted."""
    return ~((source == "text") & (page == "entity")) | (index <= last)


def _has(tokens: Column, forms: set[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in sorted(forms)]))


def fact_marks(text: Column | str) -> list[Column]:
    """What the test for one fact needs of a text: words of death, birth and marriage, and phrases of a date of death or birth."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    has = lambda parts, x: F.when(_any(low, parts), x).otherwise(_any(low, parts))
    tokens = words(low)
    told_death = F.contains(low, F.lit("date of death")) | F.contains(low, F.lit("death date"))
    told_birth = F.contains(low, F.lit("date of birth")) | has(["birthdate"], F.array_contains(tokens, "birthdate"))
    # By the shortest forms, which the others contain.
    return [has(["die", "dying", "death", "dead"], _has(tokens, _death)), has(["bear", "bore", "born", "birth"], _has(tokens, _birth)), has(["spouse"], _has(tokens, _spouse)), told_death, told_birth]


def marked_same_fact(marks: Column, other: Column, b: Column, e: Column, cs: Column, ce: Column, ids: Column, other_ids: Column) -> Column:
    """``same_fact`` of texts whose ``fact_marks`` are known, as arrays."""
    death, birth, spouse, told_death, told_birth = ((marks[i], other[i]) for i in range(5))
    either = (death[0] & told_death[1]) | (death[1] & told_death[0]) | (birth[0] & told_birth[1]) | (birth[1] & told_birth[0])
    near = ((b == cs) & (e == ce)) | (F.abs(b - cs) < 2) | (F.abs(e - ce) < 2)
    items = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: F.startswith(x, F.lit("Q")))))
    return either | (near & ((birth[0] & birth[1]) | (death[0] & death[1]) | (spouse[0] & spouse[1]) | (items(ids) == items(other_ids))))


def same_fact(text: Column, other: Column, b: Column, e: Column, cs: Column, ce: Column, ids: Column, other_ids: Column) -> Column:
    """Two snippets that tell one fact: a death or birth beside its date's phrase, or nearly equal dates with one theme or equal items."""
    return marked_same_fact(F.array(*fact_marks(text)), F.array(*fact_marks(other)), b, e, cs, ce, ids, other_ids)


def asks_time(question: Column) -> Column:
    """A question for a time; the first test that holds decides, and "yearly" escapes it to the later ones."""
    q = F.lower(question)
    has = lambda s: F.contains(q, F.lit(s))
    tokens = F.split(F.trim(F.regexp_replace(q, r"\s+", " ")), " ")
    bare = F.array_contains(tokens, "when") & ~F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ("what", "which", "who", "where")]))
    later = has("which month") | (has("which year") & ~has("which yearly")) | has("which date") | has("what date") | has("what time") | bare
    return has("during what") | has("during which") | (has("what year") & ~has("what yearly")) | later


def entity_count(main: Column, constraint: Column) -> Column:
    """How many different entities a question's main and constraint name; null arrays name none."""
    none = F.array().cast("array<string>")
    return F.size(F.array_distinct(F.concat(F.coalesce(main, none), F.coalesce(constraint, none))))


def question_flaw(question: Column, answers: Column, entities: Column, least_words: int = 8, most_answers: int = 10, most_entities: int = 10) -> Column:
    """The first flaw of a question, null if it has none. ``answers`` and ``entities`` are counts."""
    from .text import word_count

    tokens = words(F.lower(question))
    q = F.lower(question)
    return (
        F.when(word_count(question) < least_words, "short")
        .when(answers > most_answers, "answers")
        .when(F.exists(tokens, lambda w: w.rlike(r"^\d{4}$")), "year")
        .when(F.exists(tokens, lambda w: w.rlike(r"^q\d+$")), "item")
        .when(F.contains(q, F.lit("??")) | (F.contains(q, F.lit("(")) & ~F.contains(q, F.lit(")"))), "strange")
        .when(entities > most_entities, "entities")
        .when(F.contains(q, F.lit("how many")), "number")
        .when(asks_time(question), "time")
    )


def signal_kept(question: Column, signal: Column) -> Column:
    """Whether the question's words still fit its signal; null for other signals."""
    q = F.lower(question)
    return F.when(signal == "OVERLAP", ~q.rlike("after|before")).when(signal.isin("BEFORE", "AFTER"), ~q.rlike("during|while|in the year|when|at the time"))

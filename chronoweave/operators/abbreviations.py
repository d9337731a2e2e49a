"""Abbreviations learned from texts: words that have a full stop behind them more often than words at a sentence's end do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word of letters, full stops within it, and one behind it if there is one.
WORD = r"\p{L}(?:[\p{L}.]*\p{L})?\.?"
#: Scores from which a word is an abbreviation, and the share of an abbreviation's occurrences that have their full stop.
LEAST, SURE = 0.3, 0.99


def period_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(word, dotted, plain)``: how often each word, A-Z lower-cased, stands with and without a full stop behind it, over all rows. Null texts have no words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    said = texts.select(F.explode(F.regexp_extract_all(F.translate(F.col(f"`{column}`"), upper, upper.lower()), F.lit(WORD), F.lit(0))).alias("w"))
    dotted = F.endswith("w", F.lit("."))
    return said.groupBy(F.rtrim("w", F.lit(".")).alias("word")).agg(F.count_if(dotted).alias("dotted"), F.count_if(~dotted).alias("plain"))


def scores(counts: DataFrame) -> DataFrame:
    """``counts`` with ``score``: the log-likelihood ratio that the full stop belongs to the word, as short words, full stops within and no occurrences without one make it likelier.

    Totals are one row, so that no word is shuffled again. Words without a full stop have none.
    """
    totals = counts.agg(F.sum("dotted").alias("dots"), F.sum(F.col("dotted") + F.col("plain")).alias("words"))
    d, p = F.col("dotted").cast("double"), F.col("plain").cast("double")
    rate = F.col("dots") / F.col("words")
    told = lambda q: d * F.ln(q) + p * F.ln(1 - q)
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    ratio = 2 * (told(F.lit(SURE)) - told(F.least(rate, F.lit(SURE))))
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -p)
    return counts.where("dotted > 0").join(F.broadcast(totals)).select("word", "dotted", "plain", score.alias("score"))


def abbreviations(texts: DataFrame, column: str = "text", least: float = LEAST) -> DataFrame:
    """``(word, dotted, plain, score)`` of the abbreviations of ``texts``; none of an empty table. One shuffle, of counts that are summed before it."""
    return scores(period_counts(texts, column)).where(F.col("score") >= least)


def abbreviation_list(found: DataFrame, most: int = 5000) -> list[str]:
    """The words of ``abbreviations`` for ``text.sentences``; an error if there are more than ``most``, as they go into a pattern."""
    words = [r["word"] for r in found.select("word").limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} abbreviations: raise the least score")
    return sorted(words)

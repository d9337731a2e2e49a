"""Rephrasing: prompts, a cache, a pluggable provider, and the rule filters after it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import question_flaw, signal_kept
from ..functions.text import squeeze, word_count
from ..session import stored

CACHE = "prompt string, question string, version double"
PROMPT = "Turn the statement into one fluent question.\nStatement: {}\nQuestion:"


def prompt(question: Column, text: str = PROMPT) -> Column:
    before, _, after = text.partition("{}")
    return F.concat(F.lit(before), question, F.lit(after))


def by_template(question: Column) -> Column:
    """The default provider: parts joined by their signal word, a question mark at the end. Deterministic."""
    joined = F.regexp_replace(question, r", (before|after|during), ", " $1 ")
    return F.concat(F.regexp_replace(squeeze(joined), r"[\s.,]+$", ""), F.lit("?"))


def answered(prompts: DataFrame, provider: Callable[[pd.Series], pd.Series], cache: DataFrame | None = None, attempts: int = 2) -> DataFrame:
    """``(prompt, question)`` of the distinct ``prompts`` that ``cache`` lacks, each asked once, and again up to ``attempts`` times where the provider fails (gives null).

    Answers are written before anything reads them, so no retry of a later stage asks anew.
    """

    @F.pandas_udf("string")
    def ask(batch: pd.Series) -> pd.Series:
        out = provider(batch)
        for _ in range(attempts - 1):
            failed = out.isna()
            if not failed.any():
                break
            out = out.where(~failed, provider(batch[failed]).reindex(out.index))
        return out

    missing = prompts.select("prompt").where("prompt is not null").distinct()
    if cache is not None:
        missing = missing.join(cache.select("prompt"), "prompt", "left_anti")
    return stored(missing.withColumn("question", ask("prompt")), "answers")


def rephrased(questions: DataFrame, cache: DataFrame | None = None, provider: Callable[[pd.Series], pd.Series] | None = None, column: str = "question") -> DataFrame:
    """``questions`` with their prompt and rephrase_question: from ``cache(prompt, question, version)``, else by the provider, else by a template.

    A provider maps prompts to questions, nulls where it fails, batch by batch; equal prompts reach it once, those that the cache has not at all.
    """
    asked = questions.withColumn("prompt", prompt(F.col(column)))
    known = None
    if cache is not None:
        known = cache.groupBy("prompt").agg(F.max_by("question", "version").alias("_known"))
    if provider is not None:
        new = answered(asked, provider, cache).select("prompt", F.col("question").alias("_known"))
        known = new if known is None else known.unionByName(new)
    out = asked.join(known, "prompt", "left") if known is not None else asked.withColumn("_known", F.lit(None).cast("string"))
    default = by_template(F.col(column)) if provider is None else F.lit(None).cast("string")
    return out.withColumn("rephrase_question", F.coalesce("_known", default)).drop("_known")


def rephrased_with_cache(questions: DataFrame, path: str, provider: Callable[[pd.Series], pd.Series], version: float, column: str = "question") -> DataFrame:
    """As ``rephrased``, with the cache at ``path``: new answers are committed to it under ``version`` before they are used; failures are not, and are asked again next time."""
    from ..sources.io import read_cache, upsert_cache

    spark = questions.sparkSession
    cache = read_cache(spark, path, CACHE)
    asked = questions.withColumn("prompt", prompt(F.col(column)))
    new = answered(asked, provider, cache).where("question is not null").withColumn("version", F.lit(float(version)))
    known = upsert_cache(spark, path, new, ["prompt"]).select("prompt", F.col("question").alias("rephrase_question"))
    return asked.join(known, "prompt", "left")


def checked(questions: DataFrame, answers: Column, entities: Column, relation: Column) -> DataFrame:
    """``questions`` with word number, flaw and whether the signal is kept (that never drops one)."""
    q = F.col("rephrase_question")
    return questions.withColumns({"n_words": word_count(q), "flaw": question_flaw(q, answers, entities), "check_signal": signal_kept(q, relation)})

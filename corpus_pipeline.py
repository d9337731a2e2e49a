"""The corpus pipeline: five stages over documents, each written and read again.

All stages take nulls in any column, empty and very long texts, ties, repeated rows and empty tables; all but the
last return the columns they get, whatever further ones there are and however they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import decontam, langid, mixing, ngram_join, sharding
from chronoweave.llm.common import drop_stored, materialize, table
from chronoweave.session import ship_package

#: A document in no known language: fewer of its n-grams than this share are in the best language's filter.
LEAST_COVERAGE = 0.2
#: Near copies: five-word shingles, similarity 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those whose n-grams no learned language explains.

    The languages are learned from the documents that have a text and a lang; without any all documents go.
    Repeated rows share their fate.
    """
    ship_package(spark)
    return langid.known(docs, langid.fit(docs), LEAST_COVERAGE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the least doc_id, and one of rows that are there several times.

    Texts that share a doc_id but are unlike stay both, as do rows without words or without a doc_id.
    """
    ship_package(spark)
    return ngram_join.one_of_each_group(docs, NEAR_WORDS, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more lie in windows of the benchmark's items.

    Documents without words stay; an empty benchmark drops nothing. Repeated rows share their fate.
    """
    ship_package(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, some of them twice; the one at the cut is kept whole.

    A null source is one of its own; documents without words are in no mix. Rows that share a doc_id are
    taken each for itself.
    """
    ship_package(spark)
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the documents' columns and their ``shard`` (with underscores after it if they have such a column).

    The doc_id decides, so copies of a document are in one shard; a null one is a key like others.
    """
    ship_package(spark)
    return sharding.with_shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", keep_one_of_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
#: The first three stages have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)

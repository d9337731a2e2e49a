"""Whole records: unions of sources, duplicates, orders, lookups by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SOURCES = ("kb", "text", "info")


def of_sources(evidence: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Evidence of the sources that are asked for; a null source is none of them."""
    return evidence.where(F.col("source").isin(*sources))


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of parts whose columns may differ; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_records(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal ``keys`` the first by ``order``, whole; combined before the shuffle, so no key is hot."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first")).select(*keys, "_first.*").select(*rows.columns)


def by_frequency(entities: DataFrame, frequency: str = "frequency", key: str = "id") -> DataFrame:
    """Entities with their place by frequency, the most frequent first, ties by key; null frequencies last."""
    return placed(entities, F.desc_nulls_last(frequency), F.asc(key))


def placed(rows: DataFrame, *order: Column | str, name: str = "place", first: int = 1) -> DataFrame:
    """``rows`` with their place in an order, counted from ``first``, without all rows in one task.

    Rows are dealt by ranges and sorted in each; a row's place is its place in its range after all rows of the ranges before,
    whose sizes are one row for each range.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id() % (1 << 33)
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part).withColumn("_at", at), "placed")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_part", "_at", "_before")  # one row for each partition


def numbered_evidence(entity: DataFrame, year: DataFrame, iteration: int, *order: str) -> DataFrame:
    """Evidence of entity and year pages with its ``evidence_type`` and ``evidence_id`` "{iteration}-{n}".

    n counts from 1 over both, those of entity pages first, each in the given order; columns that one side lacks are null. Clashing columns of
    these names are replaced.
    """
    kinds = ("entity_page", "year_page")
    both = union_all(*[rows.withColumn("evidence_type", F.lit(kind)) for rows, kind in zip((entity, year), kinds)])
    numbered = placed(both, "evidence_type", *order, name="_n")  # by name entity pages are first
    return numbered.withColumn("evidence_id", F.format_string("%d-%d", F.lit(iteration), F.col("_n"))).drop("_n")


def counts_of_combinations(questions: DataFrame, main: str, constraint: str, topic: str) -> DataFrame:
    """How many questions, and topics, each combination ``"main; constraint"`` of sources has; a null source leaves its place out."""
    return document_frequency(questions.withColumn("combination", F.concat_ws("; ", main, constraint)), ["combination"], topic)


def not_sampled(pool: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """The pool without what is already sampled."""
    return pool.join(taken.select(key), key, "left_anti")


def with_path(rows: DataFrame, paths: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the page path of their id; rows without a page go. Of several paths the least counts."""
    one = paths.groupBy(F.col("id").alias("_id")).agg(F.min("path").alias("path"))
    return rows.join(one, F.col(key) == F.col("_id")).drop("_id")


def zipped_ids(paths: Column, mentions: Column, ids: Column) -> Column:
    """``array<struct<text, id>>`` of paths and mentions by position, with the path's id in a map; positions without both or without an id go."""
    both = F.transform(F.arrays_zip(paths.alias("path"), mentions.alias("text")), lambda x: F.struct(x["text"].alias("text"), F.try_element_at(ids, x["path"]).alias("id")))
    return F.filter(both, lambda x: x["id"].isNotNull() & x["text"].isNotNull())


def grouped_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Names of files by the year that they begin with; others go."""
    year = F.regexp_extract(name, r"^(\d{4})(?!\d)", 1)
    return files.withColumn("year", year.try_cast("int")).where("year is not null").groupBy("year").agg(F.array_sort(F.collect_list(name)).alias("names"))


def counts_of_topics(topics: DataFrame, rows: DataFrame, topic: str = "topic") -> DataFrame:
    """How many rows each topic has, 0 too."""
    return topics.select(topic).distinct().join(rows.groupBy(topic).agg(F.count(F.lit(1)).alias("n")), topic, "left").select(topic, F.coalesce("n", F.lit(0)).alias("n"))


def document_frequency(rows: DataFrame, keys: list[str], topic: str) -> DataFrame:
    """How often each combination of ``keys`` occurs, and in how many topics."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(topic).alias("topics"))


def one_per_entity(questions: DataFrame, entity: str, key: str, seed: int = 0) -> DataFrame:
    """One question of each entity, that of the least seeded draw."""
    from .sample import draw

    ranked = questions.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(draw(seed, entity, key), key)))
    return ranked.where("_r = 1").drop("_r")


def with_similar_main(mains: DataFrame, similar: DataFrame) -> DataFrame:
    """Mains that some other main is similar to, on either side of ``similar(main_id, other)``."""
    both = similar.select("main_id").unionByName(similar.select(F.col("other").alias("main_id"))).distinct()
    return mains.join(both, "main_id", "left_semi")

"""Reproducible samples: strata, type caps, quotas, weighted picks, rounds of sampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import drop_stored, scratch_path, stored

HUMAN = ("human", "Q5")


def draw(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that seed and columns decide, by md5 so that any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(16**13)


def stratum(frequency: Column, low: int = 20, high: int = 500) -> Column:
    return F.when(frequency < low, "long_tail").when(frequency > high, "prominent").otherwise("other")


def quotas(entities: DataFrame, size: int, ratios: dict[str, int], column: str = "stratum") -> DataFrame:
    """Each stratum's quota: its share of ``size`` rounded down, its pool at most."""
    share = F.create_map(*[x for k, r in ratios.items() for x in (F.lit(k), F.lit(int(size / sum(ratios.values()) * r)))])
    return entities.groupBy(column).agg(F.count(F.lit(1)).alias("pool")).withColumn("quota", F.least("pool", F.coalesce(F.try_element_at(share, F.col(column)), F.lit(0)).cast("long")))


def type_capped(entities: DataFrame, size: int, coverage: float = 0.1, seed: int = 0, key: str = "id", kind: str = "type", exempt: tuple[str, ...] = HUMAN) -> DataFrame:
    """In the order of seeded draws, ``size`` entities none of whose types has ``int(coverage * size) + 1`` earlier ones; exempt types have no cap, entities without a type are left out.

    ``kind`` is a type or an array of types. An earlier entity counts for all its types, whether one of them keeps it out or not,
    so an entity's rank among each of its types decides, and no fold over the pool is needed. A type's rows beyond
    its cap are pruned by a window whose rank limit Spark applies before the shuffle.
    """
    several = entities.schema[kind].dataType.typeName() == "array"
    types = F.array_distinct(F.filter(kind, lambda t: t.isNotNull())) if several else F.when(F.col(kind).isNotNull(), F.array(kind)).otherwise(F.array().cast("array<string>"))
    drawn = entities.withColumns({"_draw": draw(seed, key), "_types": types}).where(F.size("_types") > 0).withColumn("_capped", F.filter("_types", lambda t: ~t.isin(*exempt)))
    rank = F.row_number().over(Window.partitionBy("_type").orderBy("_draw", key))
    early = drawn.select(key, "_draw", F.explode("_capped").alias("_type")).withColumn("_rank", rank).where(F.col("_rank") <= int(coverage * size) + 1)
    held = early.groupBy(key).agg(F.count(F.lit(1)).alias("_held"))
    kept = drawn.where(F.size("_capped") > 0).join(held, key).where(F.col("_held") == F.size("_capped")).drop("_held")
    return kept.unionByName(drawn.where(F.size("_capped") == 0)).orderBy("_draw", key).limit(size).select(*entities.columns)


def stratified_sample(entities: DataFrame, size: int, ratios: dict[str, int], seed: int = 0, key: str = "id", column: str = "stratum", taken: DataFrame | None = None) -> DataFrame:
    """Per stratum the ``quota`` entities of least draw, none of ``taken``."""
    pool = entities if taken is None else entities.join(taken.select(key), key, "left_anti")
    quota = quotas(pool, size, ratios, column).select(column, "quota")
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy(column).orderBy(draw(seed, key), key)))
    return ranked.where(F.col("_r") <= size).join(quota, column).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def inverse_weights(rows: DataFrame, item: str, topic: str | None = None) -> DataFrame:
    """Each item's count and weight, in inverse proportion to its count; weights sum to 1. With ``topic`` also the number of topics that have it."""
    aggregates = [F.count(F.lit(1)).alias("n")] + ([F.count_distinct(topic).alias("topics")] if topic else [])
    counted = rows.groupBy(item).agg(*aggregates)
    return counted.withColumn("weight", (1 / F.col("n")) / F.sum(1 / F.col("n")).over(Window.partitionBy()))


def weighted_pick(rows: DataFrame, weights: DataFrame, topic: str, item: str, key: str, seed: int = 0) -> DataFrame:
    """One row per topic: an item drawn by weight among the topic's own, then a row of that item drawn evenly."""
    own = rows.groupBy(topic, item).agg(F.count(F.lit(1)).alias("_k")).join(weights.select(item, "weight"), item)
    by_item = Window.partitionBy(topic).orderBy(item)
    whole = F.sum("weight").over(Window.partitionBy(topic))
    reach = own.withColumn("_upto", F.sum("weight").over(by_item) / whole).withColumn("_u", draw(seed, topic))
    picked = reach.withColumn("_first", F.row_number().over(Window.partitionBy(topic).orderBy(F.when(F.col("_upto") > F.col("_u"), 0).otherwise(1), item))).where("_first = 1").select(topic, item)
    ranked = rows.join(picked, [topic, item]).withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy(draw(seed + 1, topic, key), key)))
    return ranked.where("_r = 1").drop("_r")


def sampling_rounds(pool: DataFrame, size: int, ratios: dict[str, int], rounds: int = 500, seed: int = 0, key: str = "id", column: str = "stratum", taken: DataFrame | None = None) -> DataFrame:
    """The pool's rows with the ``round`` (from 0) in which they are sampled: each stratum in the order of its draws, its share of ``size`` a round, none of ``taken``.

    A stratum that has run out gives no more. Rows beyond the last round are pruned by the window's rank limit before the shuffle.
    """
    left = pool if taken is None else pool.join(taken.select(key), key, "left_anti")
    shares = {k: int(size / sum(ratios.values()) * r) for k, r in ratios.items()}
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col(column))
    asked = left.withColumn("_share", share).where("_share > 0")
    rank = F.row_number().over(Window.partitionBy(column).orderBy(draw(seed, key), key))
    ranked = asked.withColumn("_r", rank).where(F.col("_r") <= rounds * max(shares.values()))
    return ranked.withColumn("round", F.expr("(_r - 1) div _share").cast("int")).where(F.col("round") < rounds).drop("_r", "_share")


def sample_until(pool: DataFrame, size: int, target: int, ratios: dict[str, int], produce: Callable[[DataFrame], DataFrame], key: str = "id", rounds: int = 500, seed: int = 0, column: str = "stratum", taken: DataFrame | None = None) -> DataFrame:
    """Sample without repeats and ``produce`` questions from each sample until ``target`` topics have one; rows of ``produce`` with their ``round``.

    ``produce`` takes the sampled rows and returns rows with ``key``. All rounds are drawn at once, into a table partitioned by
    round, of which each round reads its own part; each round's questions are appended to one table. No topic is sampled
    twice, so the topics of the rounds add up. An empty pool gives no rows.
    """
    spark = pool.sparkSession
    drawn = stored(sampling_rounds(pool, size, ratios, rounds, seed, key, column, taken), "rounds", partition_by=["round"])
    last = drawn.agg(F.max("round")).first()[0]
    schema = StructType([*produce(drawn.drop("round").limit(0)).schema.fields, StructField("round", IntegerType())])
    path, topics = scratch_path(spark, "made"), 0
    for i in range(-1 if last is None else last + 1):
        now = f"{path}/round={i}"
        produce(drawn.where(F.col("round") == i).drop("round")).write.parquet(now)
        topics += spark.read.schema(StructType(schema.fields[:-1])).parquet(now).select(key).distinct().count()
        if topics >= target:
            break
    drop_stored(drawn)
    if last is None:
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).option("basePath", path).parquet(path)
    out._stored_at = path
    return out


def sampled_by_batches(batches: list[tuple[int, int, int, int]], pool: DataFrame, constraints: DataFrame, size: int, ratios: dict[str, int], produce: Callable[[DataFrame, DataFrame], DataFrame], year: str = "year", key: str = "id", **options) -> DataFrame:
    """``sample_until`` for each batch ``(first year, last year, last year with halo, target)``: rows of ``produce`` with ``range_start`` and ``round``.

    A batch's entities are those of ``pool`` in its years, each once, and its constraints those of its years and the halo's.
    ``produce`` takes sampled entities and constraints. There is a batch for some decades, so the driver loops over few.
    """
    out = []
    for first, last, halo, target in batches:
        entities = pool.where(F.col(year).between(first, last)).drop(year).dropDuplicates([key])
        near = constraints.where(F.col(year).between(first, halo))
        found = sample_until(entities, size, target, ratios, lambda sampled, near=near: produce(sampled, near), key, **options)
        out.append(found.withColumn("range_start", F.lit(first)))
    return reduce(DataFrame.unionByName, out)

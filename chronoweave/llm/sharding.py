"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

SHARDS = 8
#: Fixed value of the published algorithm: the multiplier of its linear congruential generator.
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys, vectorised: each round advances the keys that still jump.

    A key's jumps are a fixed sequence, cut at ``shards``; with one more shard a key keeps its shard or
    jumps to the new one. About log(shards) rounds.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    keys = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(going):
            k = keys[going] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            keys[going] = k
            to = np.floor((at[going] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            more = to < shards
            going = going[more]
            at[going] = to[more]
    return at.astype(np.int32)


def shard_of(key, shards: int):
    """Column of the shard of a 64-bit key column."""

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards))

    return jump(key)


def stable_key(column: str):
    """64 well-mixed bits of an id; a null id has a key of its own."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def with_shard(docs: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``docs`` with their shard as a last column, called ``name``, or ``name`` with underscores after it where ``docs`` have such a column. No shuffle."""
    return docs.withColumn(free_name(docs.columns, name), shard_of(stable_key("doc_id"), shards))


def shard_rows(docs: DataFrame, shards: int = SHARDS, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: size, text_crc32, shard, slot, grown_shard.

    The doc_id and the number of shards decide on a row's shard; ``grown_shard`` is that of one more
    shard. Slots number each shard's rows from 0, gapless, ordered by a hash of the row's small columns,
    then doc_id. Rows that repeat a doc_id share its shard and get slots of their own; a null doc_id is a
    key like others; a null text has size 1 and the crc32 of no bytes; texts of any length count whole. Further
    columns are ignored, an empty table gives an empty result.

    Slots need no sort of a whole shard: rows are dealt over ``buckets`` of a shard (by default about as many as
    each then holds rows), and a bucket's first slot is the count of the buckets before it. Rows that are equal
    are one row with a count until they have their slots, so no key is hot.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), stable_key("doc_id").alias("key"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("*", shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + 1).alias("grown_shard"))
    rows = materialize(rows, "shards")
    buckets = buckets or 1 + math.isqrt(rows.count() // shards)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "size", "text_crc32", F.lit(7)), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first_slot"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("i", F.sum("copies").over(inside) - F.col("copies")).join(starts, ["shard", "bucket"])
    first = F.col("first_slot") + F.col("i")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard")


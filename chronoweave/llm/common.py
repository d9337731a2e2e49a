"""Helpers that the training-data operators share: intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: ASCII white space, the word separators of the counting and shingling operators.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[object, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) is not None:
            delete(df.sparkSession, path)
            _made.remove((df.sparkSession, path))


#: Bits of a table of keys, in words of 64.
KEY_BITS = 25


def marked_among(df: DataFrame, columns: list[str], keys: DataFrame, key_columns: list[str], mark: str) -> DataFrame:
    """``df`` with a boolean column ``mark``: true wherever ``columns`` are among ``keys``, and seldom elsewhere, so that the others need not be shuffled to be compared.

    The keys' hashes set bits of a table of at most 2 ** KEY_BITS, whose words that are not empty (524,288 at most, of 16 bytes) are
    broadcast; with more keys than bits it marks more rows, never fewer. Nulls hash like values.
    """
    taken = [*df.columns, mark]
    word, bits = free_name(taken, "key_word"), free_name(taken, "key_bits")

    def place(names: list[str]) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(1 << KEY_BITS))
        return F.shiftright(h, 6), h.bitwiseAND(63).cast("int")

    at, bit = place(key_columns)
    words = keys.select(at.alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    at, bit = place(columns)
    told = df.withColumn(word, at).join(F.broadcast(words), word, "left").withColumn(mark, F.coalesce(F.getbit(F.col(bits), bit) == 1, F.lit(False)))
    return told.select(*[F.col(f"`{c}`") for c in df.columns], mark)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores after it until no column is called so (in any case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def row_hash(df: DataFrame):
    """64 bits of all columns of a row; rows that are equal have equal ones."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id's text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def batches_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop

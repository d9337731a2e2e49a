"""Readers and writers: configuration, JSON lines, arrays and maps, text lists, year files, caches."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.questions import last_per_key
from ..operators.records import placed


def read_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_map(spark: SparkSession, path: str, element: str, key: str = "topic") -> DataFrame:
    """A JSON file that is a map from keys to arrays of ``element``: one row per element."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string, array<{element}>>")).alias(key, "items")).select(key, F.posexplode("items").alias("pos", "item")).select(key, "pos", "item.*")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_years(spark: SparkSession, path: str, first: int, last: int, schema: str) -> DataFrame:
    """Tables partitioned by ``year=YYYY``; other years' folders are not read."""
    return spark.read.schema(schema).option("basePath", path).json(path).where(F.col("year").between(first, last))


def read_year_files(spark: SparkSession, path: str, first: int, last: int, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """Files called by a year and anything, with ``suffix`` at their end (evidence ``.jsonl``, entities ``.json``): their records with ``year``. Other years' files are not read."""
    if first > last:
        return spark.createDataFrame([], f"{schema}, year int")
    names = "{" + ",".join(str(y) for y in range(first, last + 1)) + "}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{names}*{suffix}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    files = [str(s.getPath()) for s in found or [] if not re.match(r"\d{5}", s.getPath().getName())]
    if not files:
        return spark.createDataFrame([], f"{schema}, year int")
    rows = spark.read.schema(schema).option("multiLine", suffix == ".json").option("mode", "DROPMALFORMED").json(files)
    return rows.withColumn("year", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"^(\d{4})", 1).cast("int"))


def numbered(rows: DataFrame, iteration: int, *order: str) -> DataFrame:
    """Ids ``"{iteration}-{n}"`` in the order of the given columns, without sorting all rows in one task."""
    return placed(rows, *order, name="_n", first=0).withColumn("id", F.concat_ws("-", F.lit(str(iteration)), F.col("_n").cast("string"))).drop("_n")


def write_json(rows: DataFrame, path: str, skip_existing: bool = False) -> None:
    rows.write.mode("ignore" if skip_existing else "overwrite").json(path)


def write_list(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Seconds that a part of a cache stays after a compaction has taken it in, for readers that have begun.
GRACE = 3600
_INCLUDED = "_included"


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Names of a cache's parts by the time they were written: p, 20 digits of nanoseconds, an id."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n for s in fs.listStatus(where) if re.fullmatch(r"p\d{20}-[0-9a-f]{32}", n := s.getPath().getName())) if fs.exists(where) else []


def read_cache(spark: SparkSession, path: str, schema: str | StructType, keys: list[str] | None = None, version: str = "version") -> DataFrame:
    """A cache table: of each key (the first column unless named) the row of the greatest version, of equal versions that written last; empty if there is none."""
    parts = _parts(spark, path)
    empty = spark.createDataFrame([], schema)
    return _merged(spark, path, parts, empty.schema, keys or empty.columns[:1], version) if parts else empty


def _merged(spark: SparkSession, path: str, parts: list[str], schema: StructType, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(*[f"{path}/{p}" for p in parts])
    part = F.element_at(F.split(F.input_file_name(), "/"), -2)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.withColumn("_part", part).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_part")).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def upsert_cache(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str = "version", most_parts: int = 16) -> DataFrame:
    """The cache with ``new`` rows, of each key the greatest version.

    A writer adds a part under a name of its own and changes no other's, so writers never wait for each other, none
    loses rows however slow it is, and one that dies leaves nothing that counts. Beyond ``most_parts`` parts a writer also
    adds one that holds what they hold together; parts taken in go once they are older than GRACE. Errors of the file system are raised.
    """
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commit(rows: DataFrame, time_ns: int, included: list[str]) -> None:
        name = f"p{time_ns:020d}-{uuid.uuid4().hex}"
        aside = f"{path}/.{name}"
        rows.write.parquet(aside)
        out = fs.create(place(f"{aside}/{_INCLUDED}"))
        out.write(bytearray("\n".join(included).encode()))
        out.close()
        if not fs.rename(place(aside), place(f"{path}/{name}")):
            raise OSError(f"{aside} can't be renamed")

    commit(last_per_key(new.limit(0), new, keys, version), time.time_ns(), [])
    parts = _parts(spark, path)
    if len(parts) > most_parts:
        # It bears the time of the latest part in it, so that a part written meanwhile still counts as later.
        commit(_merged(spark, path, parts, new.schema, keys, version), int(parts[-1][1:21]), parts)
        for part in _taken_in(spark, path):
            if int(part[1:21]) < time.time_ns() - GRACE * 10**9:
                fs.delete(place(f"{path}/{part}"), True)
    return read_cache(spark, path, new.schema, keys, version)


def _taken_in(spark: SparkSession, path: str) -> set[str]:
    """Parts whose rows a later part holds too."""
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    parts, names = _parts(spark, path), set()
    for part in parts:  # some dozens at most
        stream = fs.open(place(f"{path}/{part}/{_INCLUDED}"))
        names |= set(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n"))
        stream.close()
    return names & set(parts)


def write_dump(rows: DataFrame, path: str) -> None:
    """A cache without versions: the rows as they are, in the place of what was there."""
    rows.write.mode("overwrite").parquet(path)


def unless_written(spark: SparkSession, path: str, schema: str | StructType, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is complete, else that which ``make`` gives, written there; nothing is planned for what is there."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)

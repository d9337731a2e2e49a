"""Dimensions behind a service: keys go to a provider in batches, each once. A function that takes a table of a dimension takes a service too."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from ..session import stored

#: Keys of one call.
BATCH = 50


@dataclass(frozen=True)
class Service:
    """A provider that maps a list of keys to rows of ``schema``, which begin with their key; keys that it does not know have none.

    A call that fails is tried ``attempts`` times; then the task fails, or, with ``skip_failed``, its keys have no rows.
    """

    schema: str
    provider: Callable[[list[str]], Iterable[tuple]]
    batch: int = BATCH
    attempts: int = 3
    pause: float = 0.5
    skip_failed: bool = False

    def ask(self, keys: list[str]) -> list[tuple]:
        for i in range(self.attempts):
            try:
                return list(self.provider(keys))
            except Exception:
                if i + 1 == self.attempts and not self.skip_failed:
                    raise
                time.sleep(self.pause * i)
        return []

    def rows(self, keys: DataFrame) -> DataFrame:
        """Rows of the distinct keys in the first column of ``keys``, nulls left out. They are written before anything reads them, so no later stage asks anew."""
        schema = keys.sparkSession.createDataFrame([], self.schema).schema
        names = schema.names
        key = keys.columns[0]
        asked = keys.select(F.col(f"`{key}`").cast(schema[0].dataType).alias("key")).where("key is not null").distinct()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            waiting: list = []
            for part in parts:
                waiting += part["key"].tolist()
                while len(waiting) >= self.batch:
                    now, waiting = waiting[: self.batch], waiting[self.batch :]
                    yield pd.DataFrame(self.ask(now), columns=names)
            if waiting:
                yield pd.DataFrame(self.ask(waiting), columns=names)

        return stored(asked.mapInPandas(run, schema), "service")


def dimension(source: DataFrame | Service, keys: DataFrame) -> DataFrame:
    """The dimension's table, or what the service has for the first column of ``keys``."""
    return source if isinstance(source, DataFrame) else source.rows(keys)


def redirect_service(respond: Callable[[list[str]], dict], **options) -> Service:
    """Redirects ``(from_path, to_title)`` by ``respond``, whose answer lists ``normalized`` titles and ``redirects``, dicts with ``from`` and ``to``.

    An asked path is normalised first, then redirected. Paths that share a normalised title all get its redirect.
    """

    def provider(keys: list[str]) -> Iterator[tuple]:
        answer = respond(keys)
        titles = {x["from"]: x["to"] for x in answer.get("normalized") or ()}
        moved = {x["from"]: x["to"] for x in answer.get("redirects") or ()}
        for key in keys:
            if (to := moved.get(titles.get(key, key))) is not None:
                yield key, to

    return Service("from_path string, to_title string", provider, **options)


class _Reader(DataSourceReader):
    """Keys come from the filters ``=`` and ``in`` on the first column; each partition is a batch of them."""

    def __init__(self, service: Service, key: str) -> None:
        self.service, self.key, self.keys = service, key, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.key,):
                asked = dict.fromkeys([f.value] if isinstance(f, EqualTo) else f.value)
                self.keys = [k for k in asked if k is not None and (self.keys is None or k in self.keys)]
            else:
                yield f

    def partitions(self):
        if self.keys is None:
            raise ValueError(f"a service is read by its key: filter {self.key} by = or in")
        n = self.service.batch
        return [InputPartition(self.keys[i : i + n]) for i in range(0, len(self.keys), n)] or [InputPartition([])]

    def read(self, partition):
        return iter(self.service.ask(partition.value) if partition.value else [])


def register_service(spark: SparkSession, name: str, service: Service) -> None:
    """``service`` as the data source ``name``: ``spark.read.format(name).load().where(...)`` asks for the keys that the filter names, and no others."""
    columns = spark.createDataFrame([], service.schema).schema

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(service, columns.names[0])

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)

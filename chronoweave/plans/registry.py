"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import shaped, star, ways


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**star.QUERIES, **shaped.QUERIES, **ways.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**star.SQL, **shaped.SQL, **ways.SQL}

"""Year ranges, targets and page pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import MONTHS


def year_ranges(spark: SparkSession, start: int, end: int, interval: int, halo: int = 0) -> DataFrame:
    """Ranges of ``interval`` years, the last one cut at ``end``; rank 1 is the newest. ``halo_end`` adds the years whose constraints count too."""
    if start > end:
        return spark.createDataFrame([], "range_start int, range_end int, halo_end int, rank int")
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(interval))).alias("range_start"))
    ranges = starts.withColumn("range_end", F.least(F.col("range_start") + interval - 1, F.lit(end)))
    return ranges.withColumn("halo_end", F.col("range_end") + halo).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("range_start"))))


def pages_per_year(pool: DataFrame) -> DataFrame:
    """How many pages of a pool each year has: ``(year, n)``, as ``apportioned_targets`` takes it."""
    return pool.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def apportioned_targets(pages: DataFrame, ranges: DataFrame, target: int) -> DataFrame:
    """Each range's sum over its years of the target's share by pages, rounded up per year. ``pages``: (year, n)."""
    total = pages.agg(F.sum("n").alias("total"))
    share = pages.crossJoin(F.broadcast(total)).select("year", F.ceil(F.col("n") * target / F.col("total")).alias("share"))  # the total is one row
    inside = F.col("year").between(F.col("range_start"), F.col("range_end"))
    return F.broadcast(ranges).join(share, inside, "left").groupBy("range_start", "range_end").agg(F.coalesce(F.sum("share"), F.lit(0)).alias("target"))


def page_pool(years: DataFrame, paths: DataFrame, portal: str = "Portal:Current_events/") -> DataFrame:
    """Pages of years and their months: ``(year, id, wiki_path, page_type)`` from ``years(year)`` and ``paths(path, id)``.

    A year's page is that of its path, else of the path without dots; without either the year is left
    out. A month's is that of its portal path, else of its plain path, and none if it is the year's own.
    """
    paths = paths.groupBy("path").agg(F.min("id").alias("id"))
    bare = paths.groupBy(F.replace("path", F.lit("."), F.lit("")).alias("bare")).agg(F.min("id").alias("bare_id"))
    year_path = F.col("year").cast("string")
    named = years.select("year", year_path.alias("path")).join(paths, "path", "left").join(bare, F.col("path") == F.col("bare"), "left")
    year_pages = named.select("year", F.coalesce("id", "bare_id").alias("id"), F.col("path").alias("wiki_path"), F.lit("year").alias("page_type")).where("id is not null")
    grid = years.select("year", F.explode(F.array(*[F.lit(m.capitalize()) for m in MONTHS])).alias("name")).select("year", F.format_string(f"{portal}%s_%d", "name", "year").alias("portal"), F.format_string("%s_%d", "name", "year").alias("plain"))
    two = grid.join(paths.select(F.col("path").alias("portal"), F.col("id").alias("portal_id")), "portal", "left").join(paths.select(F.col("path").alias("plain"), F.col("id").alias("plain_id")), "plain", "left")
    own = two.join(year_pages.select("year", F.col("id").alias("year_id")), "year", "left")
    event = own.select("year", F.coalesce("portal_id", "plain_id").alias("id"), F.when(F.col("portal_id").isNotNull(), F.col("portal")).otherwise(F.col("plain")).alias("wiki_path"), F.lit("event").alias("page_type"), "year_id")
    return year_pages.unionByName(event.where("id is not null and (year_id is null or id <> year_id)").drop("year_id"))

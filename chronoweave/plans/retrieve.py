"""Year pages to the pool of entities: anchors, event links, ids, types, the order by frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_event_anchor, is_item, local_path
from ..operators.link import resolve_paths, with_all_types, with_labels
from ..operators.records import by_frequency
from ..session import stored
from ..sources.html import page_anchors


def year_entities(pages: DataFrame, paths: DataFrame, redirects: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """``(year, id, label, types, frequency)``: entities that the ``pages(year, html)`` of a year link to, each once a year.

    Links to other sites, portals, nested and special pages and sections are none. Only paths that the dictionary does not
    know are looked up among the redirects; entities without a type are left out. Pages are parsed once.
    """
    links = stored(page_anchors(pages, "year").select("year", local_path(F.col("href")).alias("path")).where(is_event_anchor(F.col("path"))).distinct(), "year-links")
    found = resolve_paths(links, paths, redirects).where(is_item(F.col("id"))).select("year", "id").distinct()
    return with_labels(with_all_types(found, entities), labels)


def entity_pool(found: DataFrame, first: int, last: int) -> DataFrame:
    """The entities of the years ``first`` to ``last``, each once, with the number of those years and their place by frequency."""
    inside = found.where(F.col("year").between(first, last))
    pool = inside.groupBy("id").agg(F.first("label").alias("label"), F.first("types").alias("types"), F.first("frequency").alias("frequency"), F.count_distinct("year").alias("years"))
    return by_frequency(pool)

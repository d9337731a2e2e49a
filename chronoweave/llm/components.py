"""Connected components by large-star and small-star rounds (Kiveris et al., 2014) over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(v, root)`` for each vertex of ``edges(a long, b long)`` but the roots: root is the component's least vertex.

    Loops and repeated edges are allowed. Each round writes its edges to the shared folder; rounds go on
    until the edges no longer change, and deletes the round's before. Groups are joined to their minima,
    never collected.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == mark or not found["n"]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = (found["n"], found["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_stored(old, large)

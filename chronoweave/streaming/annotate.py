"""The annotators on streams: they hold no state, so the batch columns serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import annotate_dates
from ..operators.annotate import annotations
from ..operators.signals import explicit_expressions


def annotated(stream: DataFrame, column: str = "text") -> DataFrame:
    """Rows of a batch or stream with their dates, explicit expressions, and both with the ordinals as numbered annotations."""
    dated = stream.withColumn("dates", annotate_dates(F.col(column))).withColumn("expressions", explicit_expressions(F.col(column), F.col("dates")))
    return dated.withColumn("annotations", annotations(F.col(column), F.col("dates")))

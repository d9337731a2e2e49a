"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def get_session(name: str = "chronoweave", **conf: str) -> SparkSession:
    """A session with the settings that the library's plans are made for; a cluster's own settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="chronoweave-")) / "chronoweave.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session on one machine gets a folder of its own; a cluster has to name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    own = f"file://{tempfile.mkdtemp(prefix='chronoweave-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


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


class Totals:
    """How many rows each phase has written, and sums of its numbers, gathered by the writes themselves: no job is run for them."""

    def __init__(self) -> None:
        self._seen: dict[str, list[Observation]] = {}

    def observed(self, df: DataFrame, name: str) -> DataFrame:
        told = Observation(f"{name}-{uuid.uuid4().hex}")
        self._seen.setdefault(name, []).append(told)
        return df.observe(told, F.count(F.lit(1)).alias("rows"))

    def read(self) -> dict[str, int]:
        """Rows by phase, of the phases that have been written; waits for a write that runs."""
        return {name: sum(x.get["rows"] for x in seen) for name, seen in self._seen.items()}


def stored(df: DataFrame, name: str, compression: str = "snappy", partition_by: list[str] | None = None, totals: Totals | None = None, dictionary: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut by files that outlive any executor. ``totals`` counts its rows on the way.

    Rows of ids and texts are written faster without a ``dictionary`` of their values, most of which come once.
    """
    df = totals.observed(df, name) if totals else df
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", compression)
    writer = writer if dictionary else writer.option("parquet.enable.dictionary", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*tables: DataFrame | None) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) is not None:
            delete(df.sparkSession, path)
            _made.remove((df.sparkSession, path))

"""Small tables that are always replaced as a whole, safe for writers that don't know of each other.

The rows of a version lie in a folder of their run's own, so that two runs never touch the
same file. A version becomes one when its marker, a file named by its number, is created;
a file can be created once only. Who finds the number taken looks at the newer version, makes
the change to that one and tries the next number. A run that is lost before its marker
leaves files that nobody reads.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.sources.tables import read_or_empty
from seasonframe.storage import materialize

ATTEMPTS = 100
"""Versions of other writers that a writer lets go by before it gives up."""


def _markers(spark: SparkSession, path: str) -> DataFrame:
    """``version, run`` of every version."""
    text = read_or_empty(spark, f"{path}/versions", "value STRING", "text")
    if text.inputFiles():
        text = text.select(F.col("_metadata.file_name").try_cast("long").alias("version"), F.col("value").alias("run"))
        return text.filter("version IS NOT NULL")
    return spark.createDataFrame([], "version LONG, run STRING")


def newest_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and run of the newest version; 0 before the first."""
    row = _markers(spark, path).agg(F.max(F.struct("version", "run")).alias("newest")).first()
    return (row.newest.version, row.newest.run) if row.newest else (0, None)


def _rows(spark: SparkSession, path: str, schema: str, run: str | None) -> DataFrame:
    if run is None:
        return spark.createDataFrame([], schema)
    return read_or_empty(spark, f"{path}/rows/run={run}", f"{schema}, live BOOLEAN").filter("live").drop("live")


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a table; no rows before the first."""
    return _rows(spark, path, schema, newest_version(spark, path)[1])


def create_once(spark: SparkSession, file: str, text: str) -> bool:
    """Create a file with a text, or tell that it is there already.

    Stores that Hadoop reaches decide this themselves. A local file is created by the driver,
    which is where a local session runs.
    """
    target = urlparse(file)
    if target.scheme in ("", "file"):
        os.makedirs(os.path.dirname(target.path), exist_ok=True)
        try:
            with open(target.path, "x", encoding="utf8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    place = spark._jvm.org.apache.hadoop.fs.Path(file)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = store.create(place, False)
    except Exception:
        if store.exists(place):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def publish_version(
    spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame | None], run_time: datetime
) -> int | None:
    """Add the version that ``change`` makes of the newest one; its number, None if there is nothing to change.

    ``change`` is called again whenever another writer was first. One row that is not live goes
    along, so that a version without entries has a file too.
    """
    for _ in range(ATTEMPTS):
        number, newest = newest_version(spark, path)
        changed = change(_rows(spark, path, schema, newest))
        if changed is None:
            return None
        run = uuid.uuid4().hex
        marker = spark.range(1).select(F.lit(False).alias("live"))
        rows = changed.withColumn("live", F.lit(True)).unionByName(marker, allowMissingColumns=True)
        rows.withColumn("writtenAt", F.lit(run_time).cast("timestamp")).write.parquet(f"{path}/rows/run={run}")
        if create_once(spark, f"{path}/versions/{number + 1:012d}", run):
            return number + 1
    raise RuntimeError(f"{path}: other writers were first {ATTEMPTS} times")


def write_version(df: DataFrame, path: str, run_time: datetime) -> int:
    """Add a version that doesn't depend on the one before."""
    rows = materialize(df)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return publish_version(df.sparkSession, path, schema, lambda _: rows, run_time)

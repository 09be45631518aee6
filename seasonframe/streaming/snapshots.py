"""Snapshots that arrive as files, published in date order."""

from __future__ import annotations

from datetime import UTC, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seasonframe import schemas as S
from seasonframe.functions import snapshot_date_of
from seasonframe.operators.quality import QualityError, array_document_rules
from seasonframe.plans.market import publish_snapshot, reject_snapshot
from seasonframe.plans.warehouse import Warehouse, materialize
from seasonframe.sources.documents import array_documents


BATCH_FILES = 64
"""Files a batch takes, so the days it has to go through one by one are few."""


def snapshot_stream(spark: SparkSession, path: str, max_files: int = BATCH_FILES) -> DataFrame:
    """Newly arrived ``snapshot-YYYY-MM-DD.json`` files: ``value, file, snapshot_date``."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files)
    name = F.col("_metadata.file_name")
    files = reader.load(path).select("value", name.alias("file"), snapshot_date_of(name).alias("snapshot_date"))
    return files.filter("snapshot_date IS NOT NULL")


def publish_stream(
    spark: SparkSession, path: str, wh: Warehouse, checkpoint: str, *, raise_invalid: bool = False, max_files: int = BATCH_FILES
) -> StreamingQuery:
    """Publish all files that have arrived, then stop.

    Each snapshot is compared with the one before it, so the days of a batch are taken in
    order; a batch has at most ``max_files`` of them, and their rows stay distributed. Days
    come from the files, so a file without rows is seen too. A file that is no array, or
    whose rows fail a rule, goes to the reject table unless ``raise_invalid``. A replayed
    batch replaces its days, markers and rejects with the same content. The run time of a
    snapshot is midnight after its day.
    """

    def publish(batch: DataFrame, _: int) -> None:
        files = materialize(batch)
        rows = materialize(array_documents(files.select("value", "snapshot_date"), S.MARKET_ROW))
        shapes = array_document_rules(files.select(F.col("file").alias("partition"), "value"), "market", "DQ-16")
        wrong = {r["partition"]: r["message"] for r in shapes.collect()}  # at most one for each file
        for day, file in sorted((r.snapshot_date, r.file) for r in files.select("snapshot_date", "file").collect()):
            run_time = datetime.combine(day, time(), UTC) + timedelta(days=1)
            try:
                if file in wrong:
                    raise QualityError(f"market {file}: {wrong[file]}")
                publish_snapshot(spark, rows.filter(F.col("snapshot_date") == F.lit(day)), wh, day, run_time)
            except QualityError as error:
                if raise_invalid:
                    raise
                reject_snapshot(spark, wh, file, day, str(error), run_time)

    return (
        snapshot_stream(spark, path, max_files)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .start()
    )
